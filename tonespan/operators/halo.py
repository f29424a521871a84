"""Blocks of samples with the edges of their neighbours, so that what looks a little back
and ahead runs on each block by itself, in any number of tasks.

Only the edges are copied. Blocks have ``size`` samples, the last of a recording may have
fewer, and are numbered from 0 by their place; one that is missing is silence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = list[str]


def _silence(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def with_halo(blocks: DataFrame, keys: Keys, index: str, pcm: str, size: int, before: int, after: int) -> DataFrame:
    """(keys, index, pcm, left, frames): each block with up to ``before`` samples before it
    and ``after`` behind it; ``left`` of them lie before its own ``frames``. In front only
    the recording's beginning shortens the halo (a missing block is silence), behind the
    first block that is missing or short ends it."""
    back, ahead = math.ceil(before / size), math.ceil(after / size)
    samples = F.col(pcm).cast("array<double>")
    copies = [F.struct(F.col(index).cast("long").alias("to"), F.lit(0).alias("d"), samples.alias("x"))]
    for d in range(1, back + 1):  # this block stands d blocks before the one it goes to
        whole = F.concat(samples, _silence(F.greatest(F.lit(0), F.lit(size) - F.size(samples))))
        first = max(0, d * size - before)
        copies.append(F.struct((F.col(index) + d).cast("long").alias("to"), F.lit(-d).alias("d"), F.slice(whole, first + 1, size - first).alias("x")))
    for d in range(1, ahead + 1):
        copies.append(F.struct((F.col(index) - d).cast("long").alias("to"), F.lit(d).alias("d"), F.slice(samples, 1, min(size, after - (d - 1) * size)).alias("x")))
    dealt = blocks.select(*keys, F.explode(F.array(*copies)).alias("c")).select(*keys, "c.*")
    part = {d: f"_{d + back}" for d in range(-back, ahead + 1)}
    held = dealt.groupBy(*keys, "to").agg(*[F.any_value(F.when(F.col("d") == d, F.col("x")), True).alias(name) for d, name in part.items()]).where(F.col(part[0]).isNotNull())
    left = []
    for d in range(back, 0, -1):
        n = size - max(0, d * size - before)
        left.append(F.when(F.col("to") >= d, F.coalesce(part[-d], _silence(n))).otherwise(_silence(0)))
    right, open_ = [], F.size(part[0]) == size
    for d in range(1, ahead + 1):
        right.append(F.when(open_ & F.col(part[d]).isNotNull(), F.col(part[d])).otherwise(_silence(0)))
        open_ = open_ & F.col(part[d]).isNotNull() & (F.size(part[d]) == size)
    front = F.concat(*left) if left else _silence(0)
    return held.select(*keys, F.col("to").alias(index), F.concat(front, F.col(part[0]), *right).alias(pcm), F.size(front).alias("left"), F.size(part[0]).alias("frames"))


def on_halo(haloed: DataFrame, keys: Keys, index: str, pcm: str, model: Callable[[np.ndarray, int, int, int], np.ndarray]) -> DataFrame:
    """(keys, index, pcm): ``model(samples, left, frames, index)`` of each block."""
    kinds = dict(haloed.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, index]) + f", {pcm} array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, index]].copy()
            found = zip(pdf[pcm], pdf["left"], pdf["frames"], pdf[index], strict=True)
            out[pcm] = [np.asarray(model(np.asarray(x, np.float64), int(a), int(n), int(k)), np.float64) for x, a, n, k in found]
            yield out

    return haloed.select(*keys, index, pcm, "left", "frames").mapInPandas(run, schema)


def smooth(blocks: DataFrame, keys: Keys, index: str, pcm: str, size: int, before: int, after: int) -> DataFrame:
    """Each sample's mean with up to ``before`` samples before and ``after`` behind it."""

    def mean(x: np.ndarray, left: int, frames: int, _: int) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        at = np.arange(left, left + frames)
        low, high = np.maximum(0, at - before), np.minimum(len(x), at + after + 1)
        return (total[high] - total[low]) / (high - low)

    return on_halo(with_halo(blocks, keys, index, pcm, size, before, after), keys, index, pcm, mean)


def filtered(blocks: DataFrame, keys: Keys, index: str, pcm: str, size: int, taps: np.ndarray, factor: int = 1) -> DataFrame:
    """A causal filter, silence before the beginning, and of its samples every
    ``factor``-th of the recording."""

    def run(x: np.ndarray, left: int, frames: int, k: int) -> np.ndarray:
        held = np.concatenate((np.zeros(len(taps) - 1 - left), x[: left + frames]))
        return np.convolve(held, taps, "valid")[-(k * size) % factor :: factor]

    return on_halo(with_halo(blocks, keys, index, pcm, size, len(taps) - 1, 0), keys, index, pcm, run)


def voice_blocks(blocks: DataFrame, keys: Keys, index: str, pcm: str, size: int, rate: int, measure: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], before: float = 0.5, after: float = 0.1) -> DataFrame:
    """(keys, t, value) of the frames whose centres lie in their own block. ``measure``
    gives the centres (seconds from the first sample) and values of a piece, here a block
    with half a second before it and a tenth behind."""
    kinds = dict(blocks.dtypes)
    haloed = with_halo(blocks, keys, index, pcm, size, round(before * rate), round(after * rate))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, k, x, left, frames in pdf.itertuples(index=False, name=None):
                centre, value = measure(np.asarray(x, np.float64))
                # in samples of the recording: sums of seconds would round
                place = centre * rate + (k * size - left)
                own = (place >= k * size - 1e-6) & (place < k * size + frames - 1e-6)
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "t": place[own] / rate, "value": value[own]})

    return haloed.select(*keys, index, pcm, "left", "frames").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, value double")


def inference_windows(blocks: DataFrame, keys: Keys, index: str, pcm: str, size: int, per: int) -> DataFrame:
    """(keys, window, pcm, heard): windows of ``per`` blocks, one block apart, the last one
    filled up with silence; ``heard`` of its samples lie before the recording's end."""
    end = blocks.groupBy(*keys).agg(F.max(F.struct(F.col(index).cast("long").alias("i"), F.size(pcm).alias("n"))).alias("_last"))
    last = F.greatest(F.lit(0).cast("long"), F.col("_last.i") - (per - 1))
    padded = F.concat(F.col(pcm).cast("array<double>"), _silence(F.greatest(F.lit(0), F.lit(size) - F.size(pcm))))
    own = F.sequence(F.greatest(F.lit(0).cast("long"), F.col(index).cast("long") - (per - 1)), F.least(F.col(index).cast("long"), last))
    entry = F.struct((F.col(index).cast("long") - F.col("window")).cast("int").alias("d"), padded.alias("x")).alias("_e")
    dealt = blocks.join(end, keys).withColumn("window", F.explode(own)).select(*keys, "window", "_last", entry)
    # windows that no block reaches are silence
    every = end.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"), "_last", F.lit(None).cast(dealt.schema["_e"].dataType).alias("_e"))
    held = dealt.unionByName(every).groupBy(*keys, "window", "_last").agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda d: F.coalesce(F.try_element_at("_m", d), _silence(size))))
    heard = F.least(F.lit(per * size).cast("long"), (F.col("_last.i") - F.col("window")) * size + F.col("_last.n"))
    return held.select(*keys, "window", whole.alias(pcm), heard.alias("heard"))


def newest(window: Column, at: Column, step: Column | float, length: Column | float) -> Column:
    """Whether a window is the one to give what lies at ``at``: the first window all of its
    time, each later one its last step. So every moment comes once."""
    start = window * step
    return F.when(window == 0, (at >= 0) & (at < start + length)).otherwise((at >= start + length - step) & (at < start + length))
