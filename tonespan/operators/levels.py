"""Framed levels and the choice of a silence threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonespan.functions.signal import AT_LEAST, audible_level, decibels
from tonespan.operators import spans
from tonespan.operators.lineage import cut

Keys = list[str]
HOP = 0.01


def block_levels(samples: DataFrame, keys: Keys, block: int, rule: str = AT_LEAST, floor: float = 1e-10) -> DataFrame:
    """(keys, i, db): level of each whole block of ``block`` samples (keys, i, x); what is
    left at the end is dropped."""
    framed = samples.groupBy(*keys, F.floor(F.col("i") / block).alias("frame")).agg(F.avg(F.col("x") * F.col("x")).alias("_m"), F.count("x").alias("_n"))
    return framed.where(F.col("_n") == block).select(*keys, F.col("frame").alias("i"), decibels(F.col("_m"), floor, rule).alias("db"))


def sliding_levels(levels: DataFrame, keys: Keys, per: int = 5) -> DataFrame:
    """(keys, i, db): level of ``per`` hops from each on, of their mean energy."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(0, per - 1)
    power = F.pow(F.lit(10.0), F.col("db") / 10)
    found = levels.select(*keys, "i", F.avg(power).over(w).alias("_e"), F.count("db").over(w).alias("_n"))
    return found.where(F.col("_n") == per).select(*keys, "i", (10 * F.log10(F.greatest("_e", F.lit(1e-20)))).alias("db"))


def otsu(levels: DataFrame, keys: Keys, bins: int = 256, least: float = -120.0) -> DataFrame:
    """(keys, split): the cut of the levels above ``least`` that best parts two classes; of
    equal cuts the first. A recording with fewer than two such levels has no row."""
    heard = levels.where(F.col("db") > least).select(*keys, "db")
    ends = heard.groupBy(*keys).agg(F.min("db").alias("_lo"), F.max("db").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col("_lo") == F.col("_hi")
    ends = ends.select(*keys, F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("db") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))
    middle = F.col("_lo") + (F.col("_bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
    # an empty bin scores as the one before it, so the first best is never empty
    counted = heard.join(ends, keys).groupBy(*keys, "_lo", "_hi", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_mid", middle)
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    mass = F.col("_c") * F.col("_mid")
    rows = counted.select(*keys, "_bin", "_mid", F.sum("_c").over(w).alias("_w0"), F.sum("_c").over(whole).alias("_w"), F.sum(mass).over(w).alias("_s0"), F.sum(mass).over(whole).alias("_s"))
    w1 = F.col("_w") - F.col("_w0")
    apart = F.col("_s0") / F.greatest("_w0", F.lit(1)) - (F.col("_s") - F.col("_s0")) / F.greatest(w1, F.lit(1))
    scored = rows.withColumn("_score", F.col("_w0") * w1 * apart * apart)
    return scored.groupBy(*keys).agg(F.min_by("_mid", F.struct(-F.col("_score"), "_bin")).alias("split"))


def floor_and_voice(levels: DataFrame, splits: DataFrame, keys: Keys) -> DataFrame:
    """(keys, split, floor, voice, audible): medians on both sides of the split (all levels
    count; without any above it the split is the voice) and the audible level."""
    split = levels.join(splits, keys)
    below, above = F.when(F.col("db") <= F.col("split"), F.col("db")), F.when(F.col("db") > F.col("split"), F.col("db"))
    found = split.groupBy(*keys, "split").agg(F.percentile(below, F.lit(0.5)).alias("floor"), F.coalesce(F.percentile(above, F.lit(0.5)), F.first("split")).alias("voice"))
    return found.withColumn("audible", audible_level(F.col("floor"), F.col("voice")))


def thresholds(measured: DataFrame, keys: Keys, start: int = -25) -> DataFrame:
    """(keys, threshold) from ``start`` down to just above the floor; at least one."""
    last = F.least(F.lit(start), F.floor(F.col("floor") + 3).cast("int"))
    return measured.select(*keys, F.explode(F.sequence(F.lit(start), last, F.lit(-1))).alias("threshold"))


def sweep(levels: DataFrame, trials: DataFrame, durations: DataFrame, keys: Keys, hop: float = HOP, shortest: int = 80, pad: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Segments kept and gaps removed at every threshold: two tables (keys, threshold,
    start, end). Silence is ``shortest`` hops or more below the threshold."""
    by = [*keys, "threshold"]
    quiet = spans.runs(levels.join(trials, keys), by, "i", F.col("db") < F.col("threshold"), shortest)
    silence = quiet.select(*by, (F.col("first") * hop).alias("start"), (F.col("stop") * hop).alias("end"))
    long_ = trials.join(durations, keys)
    # the gaps are read off the same segments; levels meet thresholds once
    kept = cut(spans.keep_segments(silence, long_, by, pad))
    return kept, spans.complement(kept, long_, by)


def audible_loss(gaps: DataFrame, sliding: DataFrame, measured: DataFrame, keys: Keys, hop: float = HOP, per: int = 5, bucket: int = 512) -> DataFrame:
    """(keys, threshold, start, end, audible_seconds, peak) of the gaps in which something
    audible is lost: the hops under a window louder than the audible level."""
    loud = sliding.join(measured.select(*keys, "audible"), keys).where("db > audible").select(*keys, "i", "db", F.floor(F.col("i") / bucket).alias("_bucket"))
    bounded = gaps.select(*keys, "threshold", "start", "end", F.ceil(F.col("start") / hop).alias("_lo"), (F.floor(F.col("end") / hop) - per + 1).alias("_hi")).where("_hi > _lo")
    cut = bounded.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor((F.col("_hi") - 1) / bucket))))
    hits = cut.join(loud, [*keys, "_bucket"]).where("i >= _lo and i < _hi")
    by = [*keys, "threshold", "start", "end"]
    following = F.lead("i").over(Window.partitionBy(*by).orderBy("i"))
    covered = F.least(F.lit(per), F.coalesce(following - F.col("i"), F.lit(per)))
    return hits.select(*by, "db", covered.alias("_c")).groupBy(*by).agg((F.sum("_c") * hop).alias("audible_seconds"), F.max("db").alias("peak"))


def trials(kept: DataFrame, losses: DataFrame, tried: DataFrame, keys: Keys) -> DataFrame:
    """(keys, threshold, kept, lost) seconds of every threshold tried."""
    by = [*keys, "threshold"]
    sums = kept.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("kept"))
    lost = losses.groupBy(*by).agg(F.sum("audible_seconds").alias("lost"))
    zero = F.lit(0.0)
    return tried.join(sums, by, "left").join(lost, by, "left").select(*by, F.coalesce("kept", zero).alias("kept"), F.coalesce("lost", zero).alias("lost"))


def choose(tried: DataFrame, keys: Keys, tolerance: float = 0.0) -> DataFrame:
    """(keys, chosen): the highest threshold that loses no more than ``tolerance``; else the
    one that loses least, the highest of equals."""
    within = F.max(F.when(F.col("lost") <= tolerance, F.col("threshold")))
    return tried.groupBy(*keys).agg(F.coalesce(within, F.min_by("threshold", F.struct("lost", -F.col("threshold")))).alias("chosen"))


def background(turns: DataFrame, levels: DataFrame, keys: Keys, label: str = "speaker", hop: float = 0.1, shortest: float = 0.3, quieter: float = 10.0) -> DataFrame:
    """(keys, label, loudness): labels at least ``quieter`` dB below the one that talks most;
    loudness is the median over turns of the 90th percentile of their levels."""
    talk = turns.groupBy(*keys, label).agg(F.sum(F.col("end") - F.col("start")).alias("talk"))
    main = talk.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("talk"), label)).alias("main"))
    counted = turns.where(F.col("end") - F.col("start") >= shortest).select(*keys, label, "start", "end").distinct()
    first, last = F.floor(F.col("start") / hop), F.ceil(F.col("end") / hop) - 1
    wide = counted.where(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    per_turn = wide.join(levels.select(*keys, "i", "db"), [*keys, "i"]).groupBy(*keys, label, "start", "end").agg(F.percentile("db", F.lit(0.9)).alias("p90"))
    loud = per_turn.groupBy(*keys, label).agg(F.percentile("p90", F.lit(0.5)).alias("loudness")).join(main, keys)
    top = loud.where(F.col(label) == F.col("main")).select(*keys, F.col("loudness").alias("top"))
    return loud.where(F.col(label) != F.col("main")).join(top, keys).where(F.col("loudness") <= F.col("top") - quieter).select(*keys, label, "loudness")


def level_of_mean(mean_square: Column) -> Column:
    """Live input level: ten times the log of the mean square, one decimal."""
    return F.round(10 * F.log10(mean_square + 1e-12), 1)
