"""Attribution of speech to parallel inputs: levels (keys, input, i, db) and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespan.operators import spans

Keys = list[str]
HOP = 0.02


def track_thresholds(levels: DataFrame, keys: Keys) -> DataFrame:
    """(keys, input, threshold): where speech on an input begins."""
    low, high = F.percentile("db", F.lit(0.1)) + 15, F.percentile("db", F.lit(0.99)) - 35
    return levels.groupBy(*keys, "input").agg(F.greatest(low, high, F.lit(-75.0)).alias("threshold"))


def loudest(levels: DataFrame, keys: Keys, digits: int = 6) -> DataFrame:
    """(keys, i, input): the input with the highest level at each moment, the first of equals
    (to ``digits`` decimals). One grouped minimum, combined before the shuffle."""
    return levels.groupBy(*keys, "i").agg(F.min_by("input", F.struct(-F.round("db", digits), "input")).alias("input"))


def activity(levels: DataFrame, limits: DataFrame, keys: Keys) -> DataFrame:
    """(keys, input, i) of the frames above the input's threshold, as far as all inputs go."""
    until = levels.groupBy(*keys, "input").agg(F.max("i").alias("_last")).groupBy(*keys).agg(F.min("_last").alias("_last"))
    return levels.join(limits, [*keys, "input"]).join(until, keys).where("db > threshold and i <= _last").select(*keys, "input", "i")


def lag_correlations(mix: DataFrame, track: DataFrame, keys: Keys, most: int = 25, least: int = 50) -> DataFrame:
    """(keys, lag, r) for shifts of up to ``most`` hops either way, levels clipped at -80;
    shifts with under ``least`` shared hops, or a constant side, are left out."""
    a = mix.select(*keys, F.col("i"), F.greatest("db", F.lit(-80.0)).alias("_a"))
    b = track.select(*keys, F.col("i").alias("_j"), F.greatest("db", F.lit(-80.0)).alias("_b"))
    moved = a.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_j", F.col("i") - F.col("lag"))
    pairs = moved.join(b, [*keys, "_j"])
    found = pairs.groupBy(*keys, "lag").agg(F.corr("_a", "_b").alias("r"), F.count(F.lit(1)).alias("_n"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    return found.where((F.col("_n") >= least) & (F.col("_sa") > 0) & (F.col("_sb") > 0)).select(*keys, "lag", "r")


def best_lag(correlations: DataFrame, keys: Keys, digits: int = 12) -> DataFrame:
    """(keys, lag): the shift with the highest correlation, the first of equals."""
    return correlations.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.round("r", digits), "lag")).alias("lag"))


def input_lags(mix: DataFrame, levels: DataFrame, keys: Keys, hop: float = HOP, most: float = 0.5, seconds: float | None = None) -> DataFrame:
    """(keys, input, lag): by how many seconds each input runs before the mix, 0 where that
    cannot be told; ``seconds``: from so much of the beginning alone. All inputs go through
    one join."""
    first = F.lit(True) if seconds is None else F.col("i") < int(seconds / hop)
    inputs = levels.select(*keys, "input").distinct()
    each = mix.where(first).join(inputs, keys).select(*keys, "input", "i", "db")
    found = best_lag(lag_correlations(each, levels.where(first), [*keys, "input"], int(most / hop)), [*keys, "input"])
    return inputs.join(found, [*keys, "input"], "left").select(*keys, "input", (F.coalesce("lag", F.lit(0)) * hop).alias("lag"))


def shift(levels: DataFrame, keys: Keys, by: int, quiet: float = -200.0) -> DataFrame:
    """Levels ``by`` hops later (earlier if negative), filled with quiet."""
    w = Window.partitionBy(*keys).orderBy("i")
    moved = F.lag("db", by, quiet) if by >= 0 else F.lead("db", -by, quiet)
    return levels.withColumn("db", moved.over(w))


def _grids(turns: DataFrame, keys: Keys, hop: float, frames) -> DataFrame:
    return spans.grid(turns, [*keys, "speaker"], hop, frames)


def _alone(active: DataFrame, keys: Keys) -> DataFrame:
    """(keys, frame, input) of the frames in which exactly one input sounds."""
    return active.groupBy(*keys, F.col("i").alias("frame")).agg(F.count(F.lit(1)).alias("_n"), F.min("input").alias("input")).where("_n = 1").drop("_n")


def homes(turns: DataFrame, active: DataFrame, keys: Keys, hop: float = HOP, frames: int | None = None, evidence: float = 3.0, share: float = 0.8) -> DataFrame:
    """(keys, speaker, input): the input that carries at least ``share`` of a speaker's solo
    frames, given ``evidence`` seconds of them. Solo: no other speaker, one input."""
    grid = _grids(turns, keys, hop, None if frames is None else F.lit(frames))
    single = grid.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_k"), F.min("speaker").alias("speaker")).where("_k = 1").drop("_k")
    solo = single.join(_alone(active, keys), [*keys, "frame"])
    counts = solo.groupBy(*keys, "speaker", "input").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys, "speaker").agg(F.sum("_n").alias("_total"), F.max(F.struct("_n", (-F.col("input")).alias("_low"))).alias("_best"))
    found = total.where((F.col("_total") * hop >= evidence) & (F.col("_best._n") / F.col("_total") >= share))
    return found.select(*keys, "speaker", (-F.col("_best._low")).cast("int").alias("input"))


def own_inputs(home: DataFrame, turns: DataFrame, active: DataFrame, keys: Keys, hop: float = HOP, frames: int | None = None, share: float = 0.8) -> DataFrame:
    """(keys, input, speaker): inputs that are home to one speaker and carry little else."""
    one = home.groupBy(*keys, "input").agg(F.count(F.lit(1)).alias("_n"), F.min("speaker").alias("speaker")).where("_n = 1").drop("_n")
    grid = _grids(turns, keys, hop, None if frames is None else F.lit(frames))
    anyone = grid.select(*keys, "frame").distinct()
    here = _alone(active, keys).join(anyone, [*keys, "frame"]).join(one, [*keys, "input"])
    mine = grid.select(*keys, "frame", "speaker", F.lit(1).alias("_mine"))
    told = here.join(mine, [*keys, "frame", "speaker"], "left").groupBy(*keys, "input", "speaker").agg((F.count("_mine") / F.count(F.lit(1))).alias("_share"))
    return told.where(F.col("_share") >= share).select(*keys, "input", "speaker")


def frame_runs(frames: DataFrame, keys: Keys, hop: float, join: float = 0.3, shortest: float = 0.2) -> DataFrame:
    """Runs of frames as spans, joined across gaps of up to ``join`` seconds, those under
    ``shortest`` dropped."""
    bare = spans.runs(frames, keys, "frame", F.lit(True))
    timed = bare.select(*keys, (F.col("first") * hop).alias("start"), (F.col("stop") * hop).alias("end"))
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) <= join, 0).otherwise(1)
    islands = timed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.where(F.col("end") - F.col("start") >= shortest).drop("_run")


def refine(
    turns: DataFrame, active: DataFrame, keys: Keys, hop: float = HOP, frames: int | None = None, evidence: float = 3.0, home_share: float = 0.8, own_share: float = 0.8, pad: float = 0.3, join: float = 0.3, shortest: float = 0.2, min_turn: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(turns, homes): a speaker with an input of their own is re-read from it, near speech
    that was found; the others keep what those do not cover and go if no piece of
    ``min_turn`` seconds is left. Recordings without own inputs keep their turns."""
    limit = None if frames is None else F.lit(frames)
    home = homes(turns, active, keys, hop, frames, evidence, home_share)
    own = own_inputs(home, turns, active, keys, hop, frames, own_share)
    owning = own.select(*keys).distinct()
    padded = turns.select(*keys, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    speech = spans.grid(padded, keys, hop, limit)
    sounding = active.select(*keys, "input", F.col("i").alias("frame")).join(speech, [*keys, "frame"]).join(own, [*keys, "input"])
    read = frame_runs(sounding, [*keys, "speaker"], hop, join, shortest)
    owned = spans.grid(read, keys, hop, limit)
    others = _grids(turns.join(own.select(*keys, "speaker"), [*keys, "speaker"], "left_anti").join(owning, keys, "left_semi"), keys, hop, limit)
    rest = frame_runs(others.join(owned, [*keys, "frame"], "left_anti"), [*keys, "speaker"], hop, join, shortest)
    enough = rest.groupBy(*keys, "speaker").agg(F.max(F.col("end") - F.col("start")).alias("_longest")).where(F.col("_longest") >= min_turn).select(*keys, "speaker")
    columns = [*keys, "start", "end", "speaker"]
    out = read.select(*columns).unionByName(rest.join(enough, [*keys, "speaker"], "left_semi").select(*columns))
    out = out.unionByName(turns.join(owning, keys, "left_anti").select(*columns))
    left = home.join(out.select(*keys, "speaker").distinct(), [*keys, "speaker"], "left_semi")
    return out, left


def mix_likeness(mix: DataFrame, tracks: DataFrame, keys: Keys, above: float = -80.0, least: int = 50) -> DataFrame:
    """(keys, r, is_mix): whether the mix's level follows the inputs' combined level."""
    power = F.sum(F.pow(F.lit(10.0), F.col("db") / 10))
    both = tracks.groupBy(*keys, "i").agg((10 * F.log10(power + 1e-20)).alias("_both"))
    used = mix.join(both, [*keys, "i"]).where(F.greatest("db", "_both") > above)
    found = used.groupBy(*keys).agg(F.corr("db", "_both").alias("r"), F.count(F.lit(1)).alias("_n"))
    return found.select(*keys, "r", ((F.col("_n") > least) & (F.col("r") > 0.8)).alias("is_mix"))
