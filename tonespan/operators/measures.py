"""Voice measures: rules, bins, summaries, resonance trend and change point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonespan.functions.signal import formant, gated_pitch, pitch_hz

Keys = list[str]
#: Fixed values of the trend: stretch and block in seconds, smallest side of a split.
STRETCH, BLOCK, MIN_SIDE, CHANGE_PERCENT, CHANGE_Z = 10.0, 2.0, 20.0, 2.0, 3.0


def rules(frames: DataFrame, gate: bool = False) -> DataFrame:
    """Undefined (0 or null) measures to null, pitch in Hz within range, optionally gated by
    harmonicity, formants only while voiced."""
    f0 = pitch_hz(F.col("semitones"))
    if gate:
        f0 = gated_pitch(f0, F.col("hnr"))
    out = frames.withColumn("f0", f0)
    for c in ("f1", "f2", "f3"):
        out = out.withColumn(c, formant(F.when(F.col(c) != 0, F.col(c)), F.col("f0")))
    return out.drop("semitones")


def bin_equal(series: DataFrame, keys: Keys, index: str, value: str, target: int) -> DataFrame:
    """(keys, bin, value): medians of at most ``target`` bins of nearly equal counts, bin
    bounds at whole parts of n / target; a series of no more than ``target`` stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1
    numbered = series.select(*keys, value, place.alias("_i"), n.alias("_n"))
    bin_ = F.when(F.col("_n") <= target, F.col("_i").cast("long")).otherwise(F.expr(f"((_i + 1) * {target} - 1) div _n"))
    return numbered.groupBy(*keys, bin_.alias("bin")).agg(F.percentile(value, F.lit(0.5)).alias("value"))


def bin_time(series: DataFrame, keys: Keys, at: str, value: str, duration: Column, points: int) -> DataFrame:
    """(keys, bin, value): medians of ``points`` bins of time, the last also for later
    moments; values or moments that are null are dropped."""
    bin_ = F.least(F.lit(points - 1), F.greatest(F.lit(0), F.floor(F.col(at) / duration * points))).cast("int")
    known = series.where(F.col(at).isNotNull() & F.col(value).isNotNull() & (duration > 0))
    return known.groupBy(*keys, bin_.alias("bin")).agg(F.percentile(value, F.lit(0.5)).alias("value"))


def summary(frames: DataFrame, keys: Keys) -> DataFrame:
    """(keys, median, p10, p90, voiced, hnr): pitch quantiles, percent voiced, median
    harmonicity."""
    p = {name: F.percentile("f0", F.lit(q)).alias(name) for name, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))}
    return frames.groupBy(*keys).agg(*p.values(), (100 * F.count("f0") / F.count(F.lit(1))).alias("voiced"), F.percentile("hnr", F.lit(0.5)).alias("hnr"))


def guide_shares(frames: DataFrame, keys: Keys, low: float, high: float) -> DataFrame:
    """(keys, below, above): percent of voiced frames under and over two guides."""
    return frames.where("f0 is not null").groupBy(*keys).agg((100 * F.avg((F.col("f0") < low).cast("int"))).alias("below"), (100 * F.avg((F.col("f0") > high).cast("int"))).alias("above"))


def index_quantiles(frames: DataFrame, keys: Keys, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles by place: the value at floor(q n) in order, the last at most."""
    known = frames.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    placed = known.select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    found = [F.max(F.when(F.col("_i") == F.least(F.floor(q * F.col("_n")), F.col("_n") - 1), F.col(value))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(*keys).agg(*found)


def usable(frames: DataFrame, keys: Keys) -> DataFrame:
    """(keys, t, level, s1, s2, lp, f0) of frames whose formants are all there, in order and
    in a plausible range."""
    fine = frames.where("f0 > 40 and f1 between 150 and 1200 and f2 between 500 and 3500 and f3 between 1200 and 5000 and f1 < f2 and f2 < f3")
    a, b, c = F.log("f1"), F.log("f2"), F.log("f3")
    return fine.select(*keys, "t", ((a + b + c) / 3).alias("level"), (b - a).alias("s1"), (c - b).alias("s2"), F.log("f0").alias("lp"), "f0")


FEATURES = ("s1", "s2", "s1s1", "s2s2", "s1s2", "lp")


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"s1s1": F.col("s1") * F.col("s1"), "s2s2": F.col("s2") * F.col("s2"), "s1s2": F.col("s1") * F.col("s2")})


def within_stretch(rows: DataFrame, keys: Keys, columns: list[str], stretch: float = STRETCH) -> DataFrame:
    """``columns`` less their mean within each stretch of time, as ``d_<column>``."""
    w = Window.partitionBy(*keys, F.floor(F.col("t") / stretch))
    return rows.withColumns({f"d_{c}": F.col(c) - F.avg(c).over(w) for c in columns})


def fit(rows: DataFrame, keys: Keys, ridge: float = 1e-9, stretch: float = STRETCH) -> DataFrame:
    """(keys, coef): how level follows the features within stretches. The sums of products
    are added up by Spark; only the 6 x 6 systems are solved in Python."""
    centred = within_stretch(_features(rows), keys, [*FEATURES, "level"], stretch)
    names = [f"d_{c}" for c in FEATURES]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, "d_level"])]
    sums = centred.groupBy(*keys).agg(F.array(*products).alias("_p"))
    k = len(FEATURES)

    def solve(batches):
        for pdf in batches:
            coef = []
            for p in pdf["_p"]:
                m = np.asarray(p, float).reshape(k, k + 1)
                coef.append(np.linalg.lstsq(m[:, :k] + ridge * np.eye(k), m[:, k], rcond=None)[0].tolist())
            yield pd.concat([pdf[keys], pd.Series(coef, index=pdf.index, name="coef")], axis=1)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", coef array<double>")


def residuals(rows: DataFrame, keys: Keys, coefs: DataFrame) -> DataFrame:
    """(keys, t, f0, r): level less what the features explain, zero on average."""
    joined = _features(rows).join(coefs, keys)
    explained = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(FEATURES)), F.lit(0.0))
    raw = joined.select(*keys, "t", "f0", (F.col("level") - explained).alias("_r"))
    return raw.select(*keys, "t", "f0", (F.col("_r") - F.avg("_r").over(Window.partitionBy(*keys))).alias("r"))


def trend(rows: DataFrame, keys: Keys, duration: float, dt: float, step: float = 0.5, window: float = 10.0, near: float = 0.75, enough: float = 3.0) -> DataFrame:
    """(keys, t, pct, conf) every ``step`` seconds where speech is near: percent above or
    below the usual, and how much speech stands behind it."""
    last = int(duration / step)
    half, close = round(window / 2 * 1e6), round(near * 1e6)

    def at(k: Column) -> Column:
        return k * step + step / 2

    def micro(t: Column) -> Column:
        return F.round(t * 1_000_000).cast("long")

    def passed(offset: int) -> Column:
        """The last moment that, moved by ``offset``, is not after the row."""
        k = F.floor((F.col("_u") - offset) / (step * 1e6) - 0.5)
        k = k + F.when(micro(at(k + 1)) + offset <= F.col("_u"), 1).when(micro(at(k)) + offset > F.col("_u"), -1).otherwise(0)
        return F.greatest(F.lit(-1).cast("long"), F.least(F.lit(last).cast("long"), k))

    # rows that no edge of a window parts are one row: the frames then hold as many rows as
    # there are edges in them, however many rows there are
    sides = {f"_{i}": passed(offset) for i, offset in enumerate((-half, half, -close, close))}
    cells = rows.select(*keys, "r", micro(F.col("t")).alias("_u")).groupBy(*keys, *[c.alias(name) for name, c in sides.items()])
    cells = cells.agg(F.min("_u").alias("_u"), F.sum("r").alias("_s"), F.count("r").alias("_n")).select(*keys, F.lit(None).cast("double").alias("t"), "_u", "_s", "_n")
    grid = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("_k"))
    grid = grid.select(*keys, at(F.col("_k")).alias("t")).where(F.col("t") < duration)
    both = cells.unionByName(grid.withColumn("_u", micro(F.col("t"))), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_u")
    wide, tight = w.rangeBetween(-half, half - 1), w.rangeBetween(-close, close - 1)
    seen = both.select(*keys, "t", F.sum("_s").over(wide).alias("_s"), F.sum("_n").over(wide).alias("_n"), F.sum("_n").over(tight).alias("_c"))
    pct = 100 * (F.exp(F.col("_s") / F.col("_n")) - 1)
    return seen.where("t is not null and _c > 0").select(*keys, "t", pct.alias("pct"), F.least(F.lit(1.0), F.col("_n") * dt / enough).alias("conf"))


def change_point(rows: DataFrame, keys: Keys, dt: float, block: float = BLOCK, min_side: float = MIN_SIDE) -> DataFrame:
    """(keys, at, pct, z, change): the split of the recording into two parts that differ
    most, judged by how much its blocks differ anyway."""
    blocks = rows.groupBy(*keys, F.floor(F.col("t") / block).alias("_b")).agg(F.sum("r").alias("_s"), F.count("r").alias("_n")).withColumn("_m", F.col("_s") / F.col("_n"))
    order = Window.partitionBy(*keys).orderBy("_b")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = {"k": F.lit(1), "s": F.col("_s"), "n": F.col("_n"), "m": F.col("_m"), "q": F.col("_m") * F.col("_m")}
    parts = {f"a_{c}": F.coalesce(F.sum(x).over(before), F.lit(0.0)) for c, x in sums.items()} | {f"w_{c}": F.sum(x).over(whole) for c, x in sums.items()}
    split = blocks.withColumns(parts).withColumns({f"b_{c}": F.col(f"w_{c}") - F.col(f"a_{c}") for c in sums})

    def side(p: str) -> tuple[Column, Column]:
        mean = F.col(f"{p}_s") / F.col(f"{p}_n")
        spread = (F.col(f"{p}_q") - 2 * mean * F.col(f"{p}_m") + F.col(f"{p}_k") * mean * mean) / F.greatest(F.lit(1.0), F.col(f"{p}_k") - 1)
        return mean, spread / F.col(f"{p}_k")

    (ma, va), (mb, vb) = side("a"), side("b")
    fair = split.where((F.col("w_k") >= 8) & (F.col("a_k") >= 2) & (F.col("b_k") > 2) & (F.col("a_n") * dt >= min_side) & (F.col("b_n") * dt >= min_side))
    scored = fair.select(*keys, (F.col("_b") * block).alias("at"), (100 * (F.exp(mb - ma) - 1)).alias("pct"), ((mb - ma) / F.sqrt(F.abs(va + vb) + 1e-12)).alias("z"))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("at", "pct", "z"), F.struct(-F.round(F.abs("z"), 9), "at")).alias("_best")).select(*keys, "_best.*")
    return best.withColumn("change", (F.abs("pct") >= CHANGE_PERCENT) & (F.abs("z") >= CHANGE_Z))


def page(rows: DataFrame, index: str, start: int, limit: int = 60_000) -> DataFrame:
    """The rows numbered from ``start`` on, ``limit`` numbers at most: what a view that has
    seen the earlier ones asks for next. A filter on the number, without a sort."""
    return rows.where(F.col(index).between(start, start + limit - 1))


def pixel_means(rows: DataFrame, keys: Keys, index: str, value: str, width: int) -> DataFrame:
    """(keys, pixel, mean, n): means of ``value`` in ``width`` equal stretches of the numbers
    0 to the highest of each key; stretches without a value are left out."""
    last = rows.groupBy(*keys).agg(F.max(index).alias("_last"))
    pixel = F.floor(F.col(index) * width / (F.col("_last") + 1)).cast("int")
    return rows.join(last, keys).where(F.col(value).isNotNull()).groupBy(*keys, pixel.alias("pixel")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def visible_means(rows: DataFrame, keys: Keys, index: str, value: str, begin: float, stop: float, duration: float, buckets: int) -> DataFrame:
    """(keys, bucket, t, mean): what lies between two moments of evenly spaced numbers 0 to
    the highest of each key, as means of whole-number strides, ``buckets`` at most, each at
    its middle in seconds. A stride without a value has a null mean, a gap of the curve."""
    n = F.col("_n")
    ends = rows.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    a = F.greatest(F.lit(0).cast("long"), F.floor(begin / duration * n))
    b = F.least(n.cast("long"), F.ceil(stop / duration * n))
    seen = ends.select(*keys, "_n", a.alias("_a"), b.alias("_b")).withColumn("_k", F.greatest(F.lit(1).cast("long"), F.ceil((F.col("_b") - F.col("_a")) / F.lit(buckets))))
    every = seen.where("_b > _a").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a") - 1) / F.col("_k")))))
    inside = rows.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_v")).join(seen, keys).where("_i >= _a and _i < _b")
    means = inside.groupBy(*keys, F.floor((F.col("_i") - F.col("_a")) / F.col("_k")).alias("bucket")).agg(F.avg("_v").alias("mean"))
    first = F.col("_a") + F.col("bucket") * F.col("_k")
    middle = (first + (F.least(first + F.col("_k"), "_b") - first) / 2) / n * duration
    return every.join(means, [*keys, "bucket"], "left").select(*keys, F.col("bucket").cast("int").alias("bucket"), middle.alias("t"), "mean")
