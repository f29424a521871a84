"""Who speaks when: models run once over windows, their outputs are stored, and recordings
are grouped from those as often as wanted, for any number of speakers, without the models.

A stored window is one row (keys, chunk, active, vecs): for each local speaker the frames in
which they talk and their voiceprint. Masks, counts and activity are built-in functions over
these arrays; only the tree of a recording's voiceprints is grouped in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonespan.operators import decode, levels, spans, vectors
from tonespan.operators.lineage import cut as kept_once

Keys = list[str]
#: Samples that a voiceprint needs.
LEAST_SAMPLES = 400


class Shape(NamedTuple):
    """Fixed values of the segmentation model: windows, steps and frames in seconds."""

    frames: int = 589
    window: float = 10.0
    step: float = 1.0
    frame_step: float = decode.FRAME_STEP
    frame_duration: float = decode.FRAME_DURATION
    rate: int = 16_000

    @property
    def least_frames(self) -> int:
        return math.ceil(self.frames * LEAST_SAMPLES / (self.window * self.rate))

    def first(self, chunk: Column) -> Column:
        """First frame of a window."""
        return F.rint(chunk * self.step / self.frame_step).cast("long")

    def total(self, chunks: Column) -> Column:
        """Frames of a recording of so many windows."""
        return F.rint((self.window + (chunks - 1) * self.step) / self.frame_step).cast("long") + 1


def talking(active: Column) -> Column:
    """How many talk in each frame."""
    return F.aggregate(active, F.array_repeat(F.lit(0), F.size(active[0])), lambda n, a: F.zip_with(n, a, lambda x, y: x + y.cast("int")))


def clean_masks(active: Column, least: int) -> Column:
    """For each local speaker the frames in which nobody else talks; all of their frames
    where ``least`` clean ones or fewer are left."""
    n = talking(active)

    def mask(a: Column) -> Column:
        clean = F.zip_with(a, n, lambda x, k: x & (k < 2))
        return F.when(F.size(F.filter(clean, lambda x: x)) > least, clean).otherwise(a)

    return F.transform(active, mask)


def pooled(mask: Column, length: int) -> Column:
    """A mask at another number of frames, each the nearest at or before its place."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(mask, (F.least(F.floor(i * F.size(mask) / length), F.size(mask) - 1) + 1).cast("int")))


Segment = Callable[[np.ndarray], np.ndarray]
Embed = Callable[[np.ndarray, np.ndarray], np.ndarray]


def segmented(windows: DataFrame, keys: Keys, segment: Segment, pcm: str = "pcm") -> DataFrame:
    """Windows (keys, window, pcm) with ``active``, from a model that turns (windows,
    samples) into (windows, frames, locals) of truth values. Samples do not move."""
    kinds = dict(windows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = np.asarray(segment(np.stack(pdf[pcm].to_list())), bool)
                out = pdf[[*keys, "window", pcm]].copy()
                out["active"] = [[local.tolist() for local in w.T] for w in found]
                yield out

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "window", pcm]) + ", active array<array<boolean>>"
    return windows.select(*keys, "window", pcm).mapInPandas(run, schema)


def voiceprints(stored: DataFrame, keys: Keys, embed: Embed, shape: Shape | None = None, length: int | None = None, pcm: str = "pcm") -> DataFrame:
    """(keys, chunk, active, vecs) of segmented windows: each talking local speaker's
    voiceprint from the clean mask, null for the silent. ``embed`` turns (samples, masks)
    of one window into a vector for each mask; ``length``: frames that it weighs."""
    shape = shape or Shape()
    mask = clean_masks(F.col("active"), shape.least_frames)
    if length:
        mask = F.transform(mask, lambda m: pooled(m, length))
    masked = stored.select(*keys, F.col("window").alias("chunk"), "active", pcm, mask.alias("_mask"))
    kinds = dict(masked.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = []
            for x, active, masks in zip(pdf[pcm], pdf["active"], pdf["_mask"], strict=True):
                talk = [k for k, a in enumerate(active) if any(a)]
                found = embed(np.asarray(x), np.stack([np.asarray(masks[k], np.float32) for k in talk])) if talk else []
                by = dict(zip(talk, found, strict=True))
                vecs.append([np.asarray(by[k], float).tolist() if k in by else None for k in range(len(active))])
            out = pdf[[*keys, "chunk", "active"]].copy()
            out["vecs"] = vecs
            yield out

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "chunk", "active"]) + ", vecs array<array<double>>"
    return masked.mapInPandas(run, schema)


def prepare(windows: DataFrame, keys: Keys, segment: Segment, embed: Embed, shape: Shape | None = None, length: int | None = None) -> DataFrame:
    """The slow part, which does not depend on the number of speakers: what ``assign``
    reads, to be stored by recording."""
    return voiceprints(segmented(windows, keys, segment), keys, embed, shape, length)


def counts(prepared: DataFrame, keys: Keys, shape: Shape) -> DataFrame:
    """(keys, frame, n): how many talk, the mean over windows rounded half to even."""
    each = prepared.select(*keys, "chunk", F.posexplode(talking(F.col("active"))).alias("_p", "_n"))
    placed = each.groupBy(*keys, (shape.first(F.col("chunk")) + F.col("_p")).alias("frame"))
    return placed.agg(F.rint(F.avg("_n")).cast("int").alias("n"))


def locals_of(prepared: DataFrame, keys: Keys) -> DataFrame:
    """(keys, chunk, local, item, active, vec) of the local speakers who talk; a vector that
    is not a number anywhere is null."""
    each = prepared.select(*keys, "chunk", F.posexplode(F.arrays_zip("active", "vecs")).alias("local", "_w"), F.size("active").alias("_n"))
    vec = F.when(~F.exists(F.col("_w.vecs"), lambda x: x.isNull() | F.isnan(x)), F.col("_w.vecs"))
    told = each.select(*keys, "chunk", "local", (F.col("chunk") * F.col("_n") + F.col("local")).alias("item"), F.col("_w.active").alias("active"), vec.alias("vec"))
    return told.where(F.exists("active", lambda x: x))


def _likest(rows: DataFrame, centers: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with ``k``, the recording's most similar center (equal ones: the least; 0
    without a vector). A recording's centers come as one array."""
    listed = centers.groupBy(*keys).agg(F.collect_list(F.struct("k", F.col("vec").alias("v"))).alias("_centers"))
    likened = F.transform("_centers", lambda c: F.struct(F.round(vectors.cosine(F.col("vec"), c["v"]), 12).alias("likeness"), (-c["k"]).alias("less")))
    return rows.join(listed, keys, "left").withColumn("k", F.coalesce(-F.array_max(likened)["less"], F.lit(0).cast("long"))).drop("_centers")


def _hard(voices: DataFrame, keys: Keys, cut: float, smallest: int, wanted: int | None) -> tuple[DataFrame, DataFrame]:
    """Cluster of every talking local speaker, and the clusters' centers."""
    grouped = kept_once(vectors.cluster(voices, keys, "item", cut=cut, smallest=smallest, wanted=wanted).withColumnRenamed("cluster", "k"))
    centers = kept_once(vectors.centroids(voices.join(grouped, [*keys, "item"]), [*keys, "k"]))
    return _likest(voices, centers, keys), centers


def _turns(told: DataFrame, counted: DataFrame, lengths: DataFrame, keys: Keys, shape: Shape) -> DataFrame:
    """(keys, k, start, end): of each frame the most active clusters, as many as talk."""
    active = told.select(*keys, "chunk", "k", F.posexplode("active").alias("_p", "_on")).where("_on")
    once = active.groupBy(*keys, "chunk", (shape.first(F.col("chunk")) + F.col("_p")).alias("frame"), "k").agg(F.lit(1.0).alias("score"))
    activity = once.groupBy(*keys, "frame", "k").agg(F.sum("score").alias("score"))
    kept = decode.top_count(activity, counted, keys)
    found = spans.runs(kept, [*keys, "k"], "frame", F.lit(True)).join(lengths, keys)
    last = F.least(F.col("stop"), F.col("frames") - 1)

    def stamp(frame: Column) -> Column:
        return decode.stamp(frame, shape.frame_step, 0.0, shape.frame_duration)

    return found.select(*keys, "k", stamp(F.col("first")).alias("start"), stamp(last).alias("end"))


def assign(prepared: DataFrame, keys: Keys, n: int | None = None, level: DataFrame | None = None, shape: Shape | None = None, cut: float = vectors.CUT, smallest: int = 1) -> tuple[DataFrame, DataFrame]:
    """(turns, background): turns (keys, speaker, start, end), speaker 0 talks most, and spans
    (keys, start, end) of voices much quieter than the main one, if ``level`` (keys, i, db,
    ten a second) is given.

    Groups are made as if the number were unknown and become families; families in the
    background are taken out. With ``n`` known, recordings with more families fold the ones
    that talk least, those with fewer are grouped anew into ``n``, of whom no more talk at
    once. Recordings without speech have no rows. ``prepared`` is read several times: store
    it first.
    """
    shape = shape or Shape()
    voices = locals_of(prepared, keys)
    lengths = prepared.groupBy(*keys).agg(shape.total(F.max("chunk") + 1).alias("frames"))
    counted = counts(prepared, keys, shape)

    def at_most(k: int) -> DataFrame:
        return counted.withColumn("n", F.least("n", F.lit(k)))

    none = prepared.select(*keys, F.lit(0.0).alias("start"), F.lit(0.0).alias("end")).where("false")
    if n == 1:
        one = _turns(voices.withColumn("k", F.lit(0).cast("long")), at_most(1), lengths, keys, shape)
        return _finished(one.withColumnRenamed("k", "speaker"), keys), none
    hard, centers = _hard(voices, keys, cut, smallest, None)
    raw = kept_once(_turns(hard, counted, lengths, keys, shape))
    groups = raw.groupBy(*keys, F.col("k").alias("speaker")).agg(F.sum(F.col("end") - F.col("start")).alias("talk"), F.max(F.col("end") - F.col("start")).alias("longest"))
    voiced = groups.join(centers.withColumnRenamed("k", "speaker"), [*keys, "speaker"], "left")
    family = kept_once(vectors.relabel(voiced, keys, "families"))
    turns = raw.join(family.withColumnRenamed("speaker", "k"), [*keys, "k"]).select(*keys, F.col("label").alias("speaker"), "start", "end")
    background = none
    if level is not None:
        quiet = levels.background(turns, level, keys).select(*keys, "speaker")
        background = spans.gap_join(turns.join(quiet, [*keys, "speaker"], "left_semi"), keys)
        turns = turns.join(quiet, [*keys, "speaker"], "left_anti")
    if n is not None:
        turns = kept_once(turns)
        found = turns.groupBy(*keys).agg(F.count_distinct("speaker").alias("_found"))
        found = kept_once(found)
        more, fewer = found.where(F.col("_found") > n).select(*keys), found.where(F.col("_found") < n).select(*keys)
        left = turns.join(more, keys, "left_semi").groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk"), F.max(F.col("end") - F.col("start")).alias("longest"))
        voice = _voices(voiced, family, keys)
        folded = vectors.relabel(left.join(voice, [*keys, "speaker"], "left"), keys, "fold", n, summed=True)
        again, _ = _hard(voices.join(fewer, keys, "left_semi"), keys, cut, smallest, n)
        anew = _turns(again, at_most(n), lengths, keys, shape).select(*keys, F.col("k").alias("speaker"), "start", "end")
        same = turns.join(more, keys, "left_anti").join(fewer, keys, "left_anti")
        turns = same.unionByName(turns.join(folded, [*keys, "speaker"]).select(*keys, F.col("label").alias("speaker"), "start", "end")).unionByName(anew)
        background = background.join(fewer, keys, "left_anti")
    return _finished(turns, keys), background


def _voices(groups: DataFrame, family: DataFrame, keys: Keys) -> DataFrame:
    """(keys, speaker, vec): each family's unit voiceprints, weighted by talk and added."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    unit = groups.where(F.col("vec").isNotNull()).withColumn("_n", norm).where("_n > 0").join(family, [*keys, "speaker"])
    parts = unit.select(*keys, "label", F.posexplode("vec").alias("_d", "_x"), (F.col("talk") / F.col("_n")).alias("_w"))
    added = parts.groupBy(*keys, "label", "_d").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"))
    listed = added.groupBy(*keys, F.col("label").alias("speaker")).agg(F.array_sort(F.collect_list(F.struct("_d", "_s"))).alias("_v"))
    return listed.select(*keys, "speaker", F.transform("_v", lambda v: v["_s"]).alias("vec"))


def _finished(turns: DataFrame, keys: Keys) -> DataFrame:
    """Turns joined across short gaps, speakers numbered by talk (ties: first to appear)."""
    joined = spans.gap_join(turns, [*keys, "speaker"])
    talk = joined.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_talk"), F.min("start").alias("_first"))
    rank = talk.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_talk"), "_first", "speaker")).cast("long") - 1)
    return joined.join(rank, [*keys, "speaker"]).select(*keys, F.col("_rank").alias("speaker"), "start", "end")


def diarize(windows: DataFrame, keys: Keys, segment: Segment, embed: Embed, path: str, n: int | None = None, level: DataFrame | None = None, shape: Shape | None = None) -> tuple[DataFrame, DataFrame]:
    """``prepare``, stored at ``path``, then ``assign``."""
    from tonespan.sources import store

    store.save(prepare(windows, keys, segment, embed, shape), path, *keys)
    return assign(windows.sparkSession.read.parquet(path), keys, n, level, shape)
