"""Parallel inputs in step: sound that arrives in pieces, late, twice or never goes out in
blocks in which every input has its place on the session's clock.

A block is due when all inputs have arrived up to its end, or the longest wait has gone by;
what is then missing is silence. The same machine serves a batch, as a pass over arrivals in
order, and a stream, as keyed state with event-time timers. When a block is due depends on
the arrivals alone, so both give the same blocks however a stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonespan.streaming.scan import scan

#: Fixed values of a session: samples a second, seconds of a block, seconds that missing
#: sound is waited for, and by how much a piece may miss the end of the one before.
RATE, BLOCK, HOLD, SNAP = 48_000, 0.05, 5.0, 0.02

BLOCKS = "block long, at long, due long, frames int, mix array<double>, inputs array<array<double>>, padded array<long>, trimmed array<long>, late array<long>"


class Clock:
    """Lengths in samples."""

    def __init__(self, rate: int = RATE, block: float = BLOCK, hold: float = HOLD, snap: float = SNAP):
        self.rate = rate
        self.block, self.hold, self.snap = round(block * rate), round(hold * rate), round(snap * rate)


class Aligner:
    """The inputs of one session. All times are samples on its clock."""

    def __init__(self, clock: Clock, inputs: int):
        self.clock, self.inputs = clock, inputs
        self.written = self.last_due = self.now = 0
        self.have = [0] * inputs
        # when each input had arrived up to a place, as (place, time), not yet written
        self.reached: list[list[tuple[int, int]]] = [[] for _ in range(inputs)]
        self.pending: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(inputs)]
        self.trimmed, self.late = [0] * inputs, [0] * inputs

    def _due(self, end: int) -> int | None:
        """When the block up to ``end`` is due; None if that is not known yet."""
        due = self.last_due
        for k in range(self.inputs):
            arrived = next((t for place, t in self.reached[k] if place >= end), None)
            limit = end + self.clock.hold
            if arrived is None and limit > self.now:
                return None
            due = max(due, limit if arrived is None else min(arrived, limit))
        return due

    def pump(self, now: int) -> list[tuple]:
        """The blocks that are due by ``now``."""
        self.now, out = max(self.now, now), []
        while (due := self._due(self.written + self.clock.block)) is not None and due <= self.now:
            out.append(self._take(self.clock.block, due))
        return out

    def place(self, source: int, at: int, pcm: np.ndarray) -> None:
        """Sound that has arrived now: close to the end of what is there it goes straight on;
        further on it leaves a gap; what reaches back is cut off, as trimmed if that place
        has sound, as late if it was written without."""
        base = max(self.have[source], self.written)
        start = base if abs(at - base) <= self.clock.snap else at
        cut = min(len(pcm), max(0, base - start))
        (self.late if self.written > self.have[source] else self.trimmed)[source] += cut
        pcm, start = pcm[cut:], max(start, base) if cut else start
        if len(pcm):
            self.pending[source].append((start, pcm))
            self.have[source] = start + len(pcm)
            self.reached[source].append((self.have[source], self.now))

    def arrive(self, source: int, at: int, pcm, now: int) -> list[tuple]:
        out = self.pump(now)
        self.place(source, at, np.asarray(pcm, np.float64))
        return out + self.pump(now)

    def finish(self) -> list[tuple]:
        """What is left, in blocks of which the last may be shorter."""
        out, end = [], max(self.have, default=0)
        while self.written < end:
            out.append(self._take(min(self.clock.block, end - self.written), self.now))
        return out

    def _take(self, frames: int, due: int) -> tuple:
        at, end = self.written, self.written + frames
        sound, padded = np.zeros((self.inputs, frames)), []
        for k in range(self.inputs):
            rest, real = [], 0
            for start, pcm in self.pending[k]:
                n = min(len(pcm), max(0, end - start))
                if n:
                    sound[k, start - at : start - at + n] = pcm[:n]
                    real += n
                if n < len(pcm):
                    rest.append((start + n, pcm[n:]))
            self.pending[k] = rest
            self.reached[k] = [x for x in self.reached[k] if x[0] > end]
            padded.append(frames - real)
        self.written, self.last_due = end, due
        return (at // self.clock.block, at, due, frames, sound.sum(axis=0).tolist(), sound.tolist(), padded, list(self.trimmed), list(self.late))

    def dump(self) -> tuple:
        """The state as numbers and lists."""
        pieces = [(k, start, pcm.tolist()) for k in range(self.inputs) for start, pcm in self.pending[k]]
        marks = [(k, place, t) for k in range(self.inputs) for place, t in self.reached[k]]
        return (self.inputs, self.written, self.last_due, self.now, self.have, self.trimmed, self.late, *(list(c) for c in (zip(*pieces, strict=True) if pieces else ([], [], []))), *(list(c) for c in (zip(*marks, strict=True) if marks else ([], [], []))))

    @classmethod
    def load(cls, clock: Clock, state: tuple) -> Aligner:
        one = cls(clock, state[0])
        one.written, one.last_due, one.now = state[1:4]
        one.have, one.trimmed, one.late = (list(x) for x in state[4:7])
        for k, start, pcm in zip(*state[7:10], strict=True):
            one.pending[k].append((start, np.asarray(pcm, np.float64)))
        for k, place, t in zip(*state[10:13], strict=True):
            one.reached[k].append((place, t))
        return one


#: State of a session: bounded by what arrives within the longest wait.
STATE = "inputs int, written long, due long, now long, have array<long>, trimmed array<long>, late array<long>, source array<int>, start array<long>, pcm array<array<double>>, marked array<int>, place array<long>, time array<long>"


class _Session:
    def __init__(self, clock: Clock):
        self.clock, self.one = clock, None

    def step(self, inputs: int, source: int, at: int, pcm, arrived: int) -> list[tuple]:
        self.one = self.one or Aligner(self.clock, int(inputs))
        return self.one.arrive(int(source), int(at), pcm, int(arrived))

    def end(self) -> list[tuple]:
        return self.one.finish() if self.one else []


def align(chunks: DataFrame, key: str, clock: Clock | None = None) -> DataFrame:
    """(key, block, at, due, frames, mix, inputs, padded, trimmed, late) of whole sessions.

    ``chunks``: (key, inputs, source, at, pcm, arrived), one row for each piece: how many
    inputs the session has, which one this is (from 0), the place of its first sample, the
    samples, and when it arrived. ``trimmed`` and ``late`` count samples of each input so
    far, ``padded`` those of the block that are silence because nothing came. Pieces that
    arrive together are taken by source and place. The rest goes out when the rows end, due
    at the last arrival. A session streams through one task, which holds what waits.
    """
    clock = clock or Clock()
    return scan(chunks, [key], ["arrived", "source", "at"], ["inputs", "source", "at", "pcm", "arrived"], lambda _: _Session(clock), BLOCKS)


class _Counted(_Session):
    """Counters of each input instead of blocks."""

    def __init__(self, clock: Clock):
        super().__init__(clock)
        self.padded = self.seen = None

    def _count(self, blocks: list[tuple]) -> None:
        for b in blocks:
            self.padded = [x + y for x, y in zip(self.padded, b[6], strict=True)]

    def step(self, inputs: int, source: int, at: int, pcm, arrived: int) -> list[tuple]:
        if self.seen is None:
            self.padded, self.seen = [0] * int(inputs), [[0, 0, 0, 0.0] for _ in range(int(inputs))]
        peak = float(np.abs(np.asarray(pcm, np.float64)).max(initial=0.0))
        one = self.seen[int(source)]
        one[0] += 1
        one[1 if peak else 2] += len(pcm)
        one[3] = max(one[3], peak)
        self._count(super().step(inputs, source, at, pcm, arrived))
        return []

    def end(self) -> list[tuple]:
        self._count(super().end())
        return [(k, n, sound, zeros, self.padded[k], self.one.trimmed[k], self.one.late[k], peak if n else None) for k, (n, sound, zeros, peak) in enumerate(self.seen or [])]


def counters(chunks: DataFrame, key: str, clock: Clock | None = None) -> DataFrame:
    """(key, source, chunks, sound, zeros, padded, trimmed, late, peak): of each input of
    each session the pieces, the samples that came in pieces with sound and in pieces of
    zeros, those that silence stands for, those cut off, and the loudest sample (null if
    nothing came)."""
    clock = clock or Clock()
    schema = "source int, chunks long, sound long, zeros long, padded long, trimmed long, late long, peak double"
    return scan(chunks, [key], ["arrived", "source", "at"], ["inputs", "source", "at", "pcm", "arrived"], lambda _: _Counted(clock), schema)


def summary(counted: DataFrame, key: str, kind: Column, rate: int = RATE) -> DataFrame:
    """(key, summary): a line on each input's seconds of sound, of silence, of nothing."""

    def seconds(c: str) -> Column:
        return F.format_string("%.1f", F.col(c) / rate)

    line = F.concat(F.lit("input "), F.col("source") + 1, F.lit(" ("), kind, F.lit("): "), seconds("sound"), F.lit(" s sound, "), seconds("zeros"), F.lit(" s pure silence, "), seconds("padded"), F.lit(" s nothing arrived"))
    line = F.concat(line, F.when(F.col("late") > 0, F.concat(F.lit(", "), seconds("late"), F.lit(" s arrived too late"))).otherwise(""))
    lines = counted.select(key, F.struct("source", line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(key, F.concat_ws("; ", F.transform("x", lambda x: x["line"])).alias("summary"))


class _Stream(StatefulProcessor):
    def __init__(self, key: str, clock: Clock):
        self.key, self.clock = key, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _out(self, key: tuple, blocks: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *b) for b in blocks], columns=[self.key, *[f.split()[0] for f in BLOCKS.split(", ")]])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        one = Aligner.load(self.clock, self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        ended = False
        for r in pd.concat(list(rows)).sort_values(["arrived", "ended", "source", "at"]).itertuples():
            one = one or Aligner(self.clock, int(r.inputs))
            if r.ended:
                out += one.pump(int(r.arrived)) + one.finish()
                ended = True
            else:
                out += one.arrive(int(r.source), int(r.at), r.pcm, int(r.arrived))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ended:
            self.state.clear()
        else:
            self.state.update(one.dump())
            # the moment at which the first block that waits has waited long enough
            due = one.written + self.clock.block + self.clock.hold
            self.handle.registerTimer(int(due * 1000 / self.clock.rate) + 1)
        yield self._out(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        one = Aligner.load(self.clock, self.state.get())
        out = one.pump(timerValues.getCurrentWatermarkInMs() * self.clock.rate // 1000) if max(one.have) > one.written else []
        self.state.update(one.dump())
        if max(one.have) > one.written:
            due = one.written + self.clock.block + self.clock.hold
            self.handle.registerTimer(max(int(due * 1000 / self.clock.rate) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._out(key, out)

    def close(self) -> None:
        pass


def align_stream(chunks: DataFrame, key: str, clock: Clock | None = None, late: str = "0 seconds") -> DataFrame:
    """The streaming form of ``align``: blocks go out as they are due. ``chunks`` has a
    column ``ended`` besides, true in a session's last row, which brings no sound and sends
    out the rest. Event time is the session clock (``arrived``); while nothing arrives for a
    session, other sessions' arrivals move time on and timers send out what has waited
    long enough. Needs the RocksDB state store."""
    clock = clock or Clock()
    timed = chunks.withColumn("_time", F.timestamp_millis((F.col("arrived") * 1000 / clock.rate).cast("long"))).withWatermark("_time", late)
    kinds = dict(chunks.dtypes)
    return timed.groupBy(key).transformWithStateInPandas(_Stream(key, clock), f"{key} {kinds[key]}, {BLOCKS}", "Append", "EventTime")
