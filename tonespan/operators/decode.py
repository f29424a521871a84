"""From overlapping window scores (chunk, frame, k, score) to labelled turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonespan.operators import spans

Keys = list[str]
FRAME_STEP, FRAME_DURATION = 0.016875, 0.0619375


def overlap_add(scores: DataFrame, keys: Keys, average: bool = True) -> DataFrame:
    """(keys, frame, k, score) over all windows; a missing score counts as none."""
    how = F.sum("score") / F.greatest(F.count("score"), F.lit(1)) if average else F.sum("score")
    return scores.groupBy(*keys, "frame", "k").agg(F.coalesce(how, F.lit(0.0)).alias("score"))


def speaker_count(active: DataFrame, keys: Keys) -> DataFrame:
    """(keys, frame, n): how many speak, the mean over windows rounded half to even.
    ``active``: (keys, chunk, frame, k, on), one row for each window, frame and k."""
    each = active.groupBy(*keys, "chunk", "frame").agg(F.count_if("on").alias("_n"))
    return each.groupBy(*keys, "frame").agg(F.rint(F.avg("_n")).cast("int").alias("n"))


def top_count(activity: DataFrame, counts: DataFrame, keys: Keys) -> DataFrame:
    """(keys, frame, k): the ``n`` most active of each frame; equal ones by least k."""
    talking = activity.join(counts.where("n > 0"), [*keys, "frame"])
    place = F.row_number().over(Window.partitionBy(*keys, "frame").orderBy(F.desc("score"), "k"))
    return talking.withColumn("_place", place).where(F.col("_place") <= F.col("n")).select(*keys, "frame", "k")


def by_cluster(active: DataFrame, clusters: DataFrame, keys: Keys) -> DataFrame:
    """(keys, frame, k, score): activity of clusters. Locals of a window that share a
    cluster count once, as the larger; windows add up. ``clusters``: (keys, chunk, local, k);
    locals without one are left out."""
    named = active.join(clusters, [*keys, "chunk", "local"])
    once = named.groupBy(*keys, "chunk", "frame", "k").agg(F.max("score").alias("score"))
    return once.groupBy(*keys, "frame", "k").agg(F.sum("score").alias("score"))


def stamp(frame: Column, step: float = FRAME_STEP, first: float = 0.0, duration: float = FRAME_DURATION) -> Column:
    return first + frame * step + duration / 2


def binarize(values: DataFrame, keys: Keys, frames: int, step: float = FRAME_STEP, duration: float = FRAME_DURATION) -> DataFrame:
    """(keys, k, start, end): turns of every k. On above one half, off below, unchanged at
    exactly one half; a missing frame is off. The last frame's stamp ends an open turn."""
    present = values.groupBy(*keys, "k").agg(F.max("value").alias("_top")).where("_top > 0.5").select(*keys, "k")
    dense = present.select(*keys, "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame"))
    full = dense.join(values.select(*keys, "k", "frame", "value"), [*keys, "k", "frame"], "left")
    value = F.coalesce("value", F.lit(0.0))
    told = F.when(value > 0.5, 1).when((value < 0.5) | (F.col("frame") == 0), 0)
    w = Window.partitionBy(*keys, "k").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    state = full.select(*keys, "k", "frame", F.last(told, ignorenulls=True).over(w).alias("_on"))
    found = spans.runs(state, [*keys, "k"], "frame", F.col("_on") == 1)
    last = F.least(F.col("stop"), F.lit(frames - 1))
    return found.select(*keys, "k", stamp(F.col("first"), step, 0.0, duration).alias("start"), stamp(last, step, 0.0, duration).alias("end"))


def label_frames(turns: DataFrame, keys: Keys, step: float = FRAME_STEP, duration: float = FRAME_DURATION) -> DataFrame:
    """(keys, frame, speaker): one label for each model frame that a turn covers; of turns
    that overlap the later one counts (by start, end, speaker)."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("start") - duration / 2) / step))
    stop = F.ceil((F.col("end") - duration / 2) / step)
    covered = turns.where(stop > first).withColumn("frame", F.explode(F.sequence(first, stop - 1)))
    return covered.groupBy(*keys, "frame").agg(F.max_by("speaker", F.struct("start", "end", "speaker")).alias("speaker"))


def window_speakers(active: DataFrame, labels: DataFrame, keys: Keys) -> DataFrame:
    """(keys, chunk, local, speaker, frames): whom each window's local speaker is, by most
    labelled frames among its active ones; of equals the least speaker."""
    hits = active.join(labels, [*keys, "frame"]).groupBy(*keys, "chunk", "local", "speaker").agg(F.count(F.lit(1)).alias("frames"))
    best = hits.groupBy(*keys, "chunk", "local").agg(F.min_by(F.struct("speaker", "frames"), F.struct(-F.col("frames"), "speaker")).alias("_best"))
    return best.select(*keys, "chunk", "local", "_best.*")
