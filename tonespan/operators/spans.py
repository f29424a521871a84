"""Span algebra: rows (keys..., start, end) of half-open spans of seconds.

Every function takes the key columns that tell recordings (or speakers) apart; all work is
partitioned by them. Joins of spans on time use buckets of time as an equality key, so
they are hash or merge joins and never compare all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _before(keys: Keys, *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def runs(frames: DataFrame, keys: Keys, index: str, flag: Column, min_length: int = 1) -> DataFrame:
    """Maximal runs of consecutive indices whose ``flag`` is true: (keys, first, stop) with
    ``stop`` exclusive, of at least ``min_length`` frames. Null flags are false."""
    on = frames.where(flag).select(*keys, F.col(index).alias("_i"))
    run = on.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys).orderBy("_i")))
    found = run.groupBy(*keys, "_run").agg(F.min("_i").alias("first"), (F.max("_i") + 1).alias("stop"))
    return found.where(F.col("stop") - F.col("first") >= min_length).select(*keys, "first", "stop")


def _islands(spans: DataFrame, keys: Keys, order: list[str], gap: float | Column = 0.0) -> DataFrame:
    """Spans numbered by island: a new one begins past the furthest end so far plus gap."""
    reach = F.max("end").over(_before(keys, *order))
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    new = F.when(F.col("start") <= reach + gap, 0).otherwise(1)
    through = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(through))


def gap_join(spans: DataFrame, keys: Keys, gap: float = 0.3) -> DataFrame:
    """Spans of a key joined across gaps of up to ``gap`` seconds (inclusive)."""
    islands = _islands(spans.select(*keys, "start", "end"), keys, ["start", "end"], gap)
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def union(spans: DataFrame, keys: Keys, pad: float = 0.0, limit: Column | None = None) -> DataFrame:
    """Padded spans of a key merged where they touch; ends clipped to ``limit`` (a span that
    begins past the limit stays, with its end before its start)."""
    end = F.col("end") + pad
    if limit is not None:
        end = F.when(limit.isNull(), end).otherwise(F.least(limit, end))
    grown = spans.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), end.alias("end"))
    islands = _islands(grown, keys, ["_s", "_e"])
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement(spans: DataFrame, durations: DataFrame, keys: Keys) -> DataFrame:
    """What sorted spans leave of [0, ``duration``): the gaps before, between and after
    them. ``durations``: keys, duration, one row each, also of those without spans."""
    edges = spans.select(*keys, "start", "end").unionByName(durations.select(*keys, F.col("duration").alias("start"), F.lit(None).cast("double").alias("end")))
    order = Window.partitionBy(*keys).orderBy(F.col("end").isNull(), "start", "end")
    gaps = edges.withColumn("_from", F.coalesce(F.lag("end").over(order), F.lit(0.0)))
    return gaps.where("start > _from").select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"))


def _bucketed(spans: DataFrame, width: float, start: str, end: str) -> DataFrame:
    low = F.floor(F.col(start) / width)
    return spans.withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col(end) / width)))))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Keys, width: float, empty: bool = False) -> DataFrame:
    """Pairs of a left and a right span that overlap (more than touch), with ``low`` and
    ``high`` of the overlap; right's other columns come along and must have names of their
    own. ``width``: seconds a time bucket, about the length of a usual span. A pair is kept
    in the bucket where its overlap begins, so it comes once. ``empty``: each span need only
    begin before the other ends, so one without length, or with its end before its start,
    also meets a span around it (``high`` is then not past ``low``)."""
    a = _bucketed(left, width, "start", "end")
    b = _bucketed(right.withColumnsRenamed({"start": "_start", "end": "_end"}), width, "_start", "_end")
    low, high = F.greatest("start", "_start"), F.least("end", "_end")
    meets = (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")) if empty else high > low
    met = a.join(b, [*keys, "_bucket"]).where(meets & (F.col("_bucket") == F.floor(low / width)))
    return met.withColumns({"low": low, "high": high}).withColumnsRenamed({"_start": "right_start", "_end": "right_end"}).drop("_bucket")


def intersect(left: DataFrame, right: DataFrame, keys: Keys, width: float, empty: bool = False) -> DataFrame:
    """Overlaps of two lists of spans; ``empty``: as in ``overlap_pairs``."""
    pairs = overlap_pairs(left.select(*keys, "start", "end"), right.select(*keys, "start", "end"), keys, width, empty)
    return pairs.select(*keys, F.col("low").alias("start"), F.col("high").alias("end"))


def overlap_total(left: DataFrame, right: DataFrame, keys: Keys, width: float) -> DataFrame:
    """Seconds of overlap of all pairs (overlapping spans of one side count again)."""
    return intersect(left, right, keys, width).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("overlap"))


def subtract(left: DataFrame, right: DataFrame, durations: DataFrame, keys: Keys, width: float, shortest: float = 0.05) -> DataFrame:
    """Left without what right covers, pieces under ``shortest`` seconds dropped."""
    free = complement(union(right, keys), durations, keys)
    return intersect(left, free, keys, width).where(F.col("end") - F.col("start") >= shortest)


def inside(points: DataFrame, spans: DataFrame, keys: Keys, at: str, width: float) -> DataFrame:
    """Points whose time lies in a span of their key: start included, end not."""
    b = _bucketed(spans.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end")), width, "_start", "_end")
    a = points.withColumn("_bucket", F.floor(F.col(at) / width))
    hit = [a[k] == b[k] for k in [*keys, "_bucket"]] + [(a[at] >= b["_start"]) & (a[at] < b["_end"])]
    condition = hit[0]
    for c in hit[1:]:
        condition = condition & c
    return a.join(b, condition, "left_semi").drop("_bucket")


def keep_segments(silences: DataFrame, durations: DataFrame, keys: Keys, pad: float = 0.15) -> DataFrame:
    """The sound between silences, padded within [0, duration), merged where pieces touch."""
    sound = complement(silences, durations, keys).join(durations.select(*keys, "duration"), keys)
    padded = sound.select(*keys, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), F.least("duration", F.col("end") + pad).alias("end"))
    return union(padded, keys)


def talk_rank(turns: DataFrame, keys: Keys, speaker: str = "speaker", gap: float = 0.3) -> DataFrame:
    """(keys, speaker, talk, rank): talk time after joining; rank 0 talks most, equal talk
    by first appearance."""
    joined = gap_join(turns, [*keys, speaker], gap)
    talk = joined.groupBy(*keys, speaker).agg(F.sum(F.col("end") - F.col("start")).alias("talk"), F.min(F.struct("start", "end")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("talk"), "_first", speaker)) - 1
    return talk.withColumn("rank", rank).drop("_first")


def merge_adjacent(pieces: DataFrame, keys: Keys, label: str, order: list[str], gap: float = 0.05) -> DataFrame:
    """Pieces merged with the one just before them (in ``order``, whatever its label) if the
    label is the same and less than ``gap`` seconds lie between."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = (F.lag(label).over(w) == F.col(label)) & (F.col("start") - F.lag("end").over(w) < gap)
    numbered = pieces.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    merged = numbered.groupBy(*keys, "_island").agg(F.min_by("start", place).alias("start"), F.max_by("end", place).alias("end"), F.first(label).alias(label))
    return merged.drop("_island")


def grid(spans: DataFrame, keys: Keys, hop: float, frames: Column | None = None) -> DataFrame:
    """(keys, frame) of every frame of ``hop`` seconds that a span touches, once each;
    ``frames``: how many there are."""
    stop = F.ceil(F.col("end") / hop)
    if frames is not None:
        stop = F.least(frames, stop)
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start") / hop))
    some = spans.where(stop > first)
    return some.select(*keys, F.explode(F.sequence(first, stop - 1)).alias("frame")).distinct()
