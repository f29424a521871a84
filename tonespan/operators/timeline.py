"""Mapping between a recording and the same recording with parts cut out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespan.operators.spans import overlap_pairs

Keys = list[str]


def offsets(segments: DataFrame, keys: Keys) -> DataFrame:
    """Segments (keys, start, end) with ``offset``, where each begins once all are joined."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(*keys, "start", "end", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)).alias("offset"))


def asof(points: DataFrame, table: DataFrame, keys: Keys, at: str, since: str) -> DataFrame:
    """Each point with the row of ``table`` whose ``since`` is the last that is not later;
    null columns if there is none. One sort of both sides together, no pairs."""
    columns = [c for c in table.columns if c not in keys]
    right = table.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_row"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in keys])
    left = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), *[c for c in points.columns if c not in keys])
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*points.columns, *[F.col("_row")[c].alias(c) for c in columns])


def points_to_source(points: DataFrame, segments: DataFrame, keys: Keys, at: str = "t") -> DataFrame:
    """``source_t``: where a moment of the joined timeline lies in the recording; null before
    the beginning and past the end."""
    found = asof(points, offsets(segments, keys), keys, at, "offset")
    inside = (F.col(at) >= 0) & (F.col(at) < F.col("offset") + (F.col("end") - F.col("start")))
    return found.select(*points.columns, F.when(inside, F.col("start") + (F.col(at) - F.col("offset"))).alias("source_t"))


def points_from_source(points: DataFrame, segments: DataFrame, keys: Keys, at: str = "t") -> DataFrame:
    """``joined_t``: where a moment of the recording lies on the joined timeline; null where
    it was cut."""
    found = asof(points, offsets(segments, keys), keys, at, "start")
    inside = (F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))
    return found.select(*points.columns, F.when(inside, F.col("offset") + (F.col(at) - F.col("start"))).alias("joined_t"))


def to_source(spans: DataFrame, segments: DataFrame, keys: Keys, width: float) -> DataFrame:
    """Spans of the joined timeline as pieces of the recording, split at each cut."""
    placed = offsets(segments, keys).select(*keys, F.col("start").alias("segment_start"), F.col("offset").alias("start"), (F.col("offset") + (F.col("end") - F.col("start"))).alias("end"))
    pairs = overlap_pairs(spans, placed, keys, width)
    start = F.col("segment_start") + (F.col("low") - F.col("right_start"))
    others = [c for c in spans.columns if c not in (*keys, "start", "end")]
    return pairs.select(*keys, *others, start.alias("source_start"), (start + (F.col("high") - F.col("low"))).alias("source_end"))


def from_source(spans: DataFrame, segments: DataFrame, keys: Keys, width: float) -> DataFrame:
    """Spans of the recording as pieces of the joined timeline; what was cut is dropped."""
    pairs = overlap_pairs(spans, offsets(segments, keys), keys, width)
    others = [c for c in spans.columns if c not in (*keys, "start", "end")]
    return pairs.select(*keys, *others, (F.col("offset") + F.col("low") - F.col("right_start")).alias("start"), (F.col("offset") + F.col("high") - F.col("right_start")).alias("end"))


def cut_samples(samples: DataFrame, segments: DataFrame, keys: Keys, rate: int) -> DataFrame:
    """Samples (keys, i, value) of the segments, renumbered without gaps: ``j``. Bounds are
    truncated to whole samples."""
    bounds = segments.select(*keys, F.floor(F.col("start") * rate).alias("_from"), F.floor(F.col("end") * rate).alias("_to"))
    before = Window.partitionBy(*keys).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    placed = bounds.withColumn("_at", F.coalesce(F.sum(F.col("_to") - F.col("_from")).over(before), F.lit(0)))
    found = asof(samples, placed, keys, "i", "_from").where(F.col("i") < F.col("_to"))
    return found.withColumn("j", F.col("_at") + F.col("i") - F.col("_from")).select(*samples.columns, "j")
