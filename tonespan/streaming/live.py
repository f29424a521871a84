"""Live sessions: placement of late audio, gap filling, windows, online labels, regrouping
and confirmation. Functions of DataFrames serve batch and streams alike where Spark allows;
the stateful ones have a batch form over whole sessions and a streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonespan.streaming.scan import scan

Keys = list[str]
#: Fixed values of a session: snap of a block to the end of the one before, distance of a
#: new voice, confirmation.
SNAP, NEW_VOICE, CONFIRM_TALK, CONFIRM_TURN = 0.02, 0.70456, 2.0, 0.8


def place(blocks: DataFrame, keys: Keys, snap: float = SNAP) -> DataFrame:
    """(keys, at, length, start, end, trimmed, late) of timed blocks in order of time: a
    block within ``snap`` of the furthest end so far begins there; one that reaches back
    loses what is covered, and is late if nothing is left."""
    reach = F.max(F.col("at") + F.col("length")).over(Window.partitionBy(*keys).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.when(F.col("at") - reach <= snap, F.greatest(reach, F.col("at") - snap)).otherwise(F.col("at"))
    placed = blocks.withColumn("_reach", reach).withColumn("start", F.coalesce(begin, F.col("at"))).withColumn("_end", F.col("at") + F.col("length"))
    cut = F.greatest(F.lit(0.0), F.least(F.col("length"), F.coalesce(F.col("_reach") - F.col("at"), F.lit(0.0))))
    late = F.coalesce(F.col("_end") <= F.col("_reach"), F.lit(False))
    return placed.select(*keys, "at", "length", "start", F.greatest("start", "_end").alias("end"), cut.alias("trimmed"), late.alias("late"))


def fill_gaps(blocks: DataFrame, keys: Keys, index: str, value: str, silence: float = 0.0) -> DataFrame:
    """One row for each block number from the first to the last of a key, silence where none
    came; ``padded`` tells which. Only the gaps are generated."""
    w = Window.partitionBy(*keys).orderBy(index)
    gap = blocks.select(*keys, (F.col(index) + 1).alias("_a"), (F.lead(index).over(w) - 1).alias("_b")).where("_b >= _a")
    filled = gap.select(*keys, F.explode(F.sequence("_a", "_b")).alias(index)).withColumns({value: F.lit(silence), "padded": F.lit(True)})
    return blocks.select(*keys, index, value, F.lit(False).alias("padded")).unionByName(filled)


def mix(blocks: DataFrame, keys: Keys, index: str, value: str) -> DataFrame:
    """Sum of the inputs in each block."""
    return blocks.groupBy(*keys, index).agg(F.sum(value).alias("mix"), F.count(F.lit(1)).alias("inputs"))


def windows(rows: DataFrame, keys: Keys, at: str, length: str, slide: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates over sliding windows of event time; ``late``: how long a stream waits."""
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(*keys, F.window(at, length, slide).alias("window")).agg(*aggregates)


def sessions(rows: DataFrame, keys: Keys, at: str, gap: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates over runs of events no more than ``gap`` apart."""
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(*keys, F.session_window(at, gap).alias("session")).agg(*aggregates)


class Voices:
    """Sums of the unit voiceprints of the speakers so far."""

    def __init__(self, known: dict[int, tuple[np.ndarray, int]] | None = None, most: int | None = None, distance: float = NEW_VOICE):
        self.known, self.most, self.distance = known or {}, most, distance

    def label(self, vector: np.ndarray) -> int:
        """The nearest speaker's number; a new one if none is near and there is room."""
        unit = vector / (np.linalg.norm(vector) + 1e-12)
        apart = {k: float(np.linalg.norm(total / n - unit)) for k, (total, n) in self.known.items()}
        k = min(apart, key=lambda x: (apart[x], x)) if apart else None
        full = self.most is not None and len(self.known) >= self.most
        if k is None or (apart[k] > self.distance and not full):
            k = max(self.known, default=-1) + 1
        total, n = self.known.get(k, (np.zeros_like(unit), 0))
        self.known[k] = (total + unit, n + 1)
        return k


def label_online(prints: DataFrame, keys: Keys, order: str, vector: str = "vec", most: int | None = None, distance: float = NEW_VOICE) -> DataFrame:
    """(keys, order, speaker): each voiceprint of a session to the nearest speaker so far, in
    order. The outcome depends on the order, so a session streams through one task."""

    kind = dict(prints.dtypes)[order]
    return scan(prints, keys, [order], [order, vector], lambda _: _Labels(Voices(most=most, distance=distance)), f"{order} {kind}, speaker long")


class _Labels:
    """Voiceprints of a session in order; its speakers so far are all that is kept."""

    def __init__(self, voices: Voices):
        self.voices = voices

    def step(self, at, vector) -> list[tuple]:
        return [(at, self.voices.label(np.asarray(vector, float)))]

    def end(self) -> list[tuple]:
        return []


def label_stream(prints: DataFrame, key: str, order: str, vector: str = "vec", most: int | None = None, distance: float = NEW_VOICE) -> DataFrame:
    """The streaming form of ``label_online``: the speakers of a session are its state."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        known = {k: (np.asarray(v, float), n) for k, v, n in zip(*held, strict=True)}
        voices = Voices(known, most, distance)
        rows = pd.concat(list(batches)).sort_values(order)
        labels = [voices.label(np.asarray(v, float)) for v in rows[vector]]
        kept = sorted(voices.known)
        state.update((kept, [voices.known[k][0].tolist() for k in kept], [voices.known[k][1] for k in kept]))
        yield pd.DataFrame({key: [name[0]] * len(rows), order: rows[order].to_numpy(), "speaker": labels})

    kinds = dict(prints.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, speaker long"
    state = "ids array<long>, sums array<array<double>>, counts array<long>"
    return prints.select(key, order, vector).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def merge_labels(grouped: DataFrame, online: DataFrame, until: Column) -> DataFrame:
    """Regrouped labels, and online ones that end past what the regrouping has seen."""
    return grouped.unionByName(online.where(F.col("end") > until))


def confirm(rounds: DataFrame, keys: Keys, talk: float = CONFIRM_TALK, turn: float = CONFIRM_TURN) -> DataFrame:
    """(keys, speaker, order): speakers in the order in which they are confirmed. ``rounds``:
    (keys, round, speaker, talk, longest, first, own). A speaker counts once a regrouping
    gives them enough talk and one long turn, and the one before had them too; the first
    speaker, and owners of an input, need one only."""

    kinds = dict(rounds.dtypes)
    columns = ["round", "speaker", "talk", "longest", "first", "own"]
    return scan(rounds, keys, ["round", "first", "speaker"], columns, lambda _: _Confirmed(talk, turn), f"speaker {kinds['speaker']}, order int")


class _Confirmed:
    """Rounds of a session in order: who was there in the last one, and who counts."""

    def __init__(self, talk: float, turn: float):
        self.talk, self.turn = talk, turn
        self.now, self.rows, self.streak, self.order = None, [], {}, []

    def _close(self) -> list[tuple]:
        self.streak = {r[0]: self.streak.get(r[0], 0) + 1 for r in self.rows}
        some = any(s in self.order for s in self.streak)
        out = []
        for speaker, talk, longest, own in self.rows:
            ready = talk >= self.talk and longest >= self.turn and (self.streak[speaker] >= 2 or not some or own)
            if ready and speaker not in self.order:
                out.append((speaker, len(self.order)))
                self.order.append(speaker)
                some = True
        return out

    def step(self, number, speaker, talk, longest, first, own) -> list[tuple]:
        out = []
        if number != self.now:
            out, self.now, self.rows = self._close(), number, []
        self.rows.append((speaker, talk, longest, own))
        return out

    def end(self) -> list[tuple]:
        return self._close()


def input_stats(blocks: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Counters of an input: blocks, peak, how many carry sound, how many are zero."""
    v = F.abs(F.col(value))
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.max(v).alias("peak"), F.count_if(v > 0).alias("sound"), F.count_if(v == 0).alias("zeros"))


def silent_inputs(blocks: DataFrame, keys: Keys, source: str, time: str, value: str, after: float = 3.0) -> DataFrame:
    """(keys, source, kind, seconds) of the inputs silent for ``after`` seconds or more at the
    session's last arrival: "none" if nothing arrives, "zeros" if only silence does. An input
    that never had sound is silent from its first block on; whole seconds, halves up."""
    t = F.col(time)
    last = blocks.groupBy(*keys, source).agg(F.min(t).alias("_first"), F.max(t).alias("_arrived"), F.max(F.when(F.col(value) != 0, t)).alias("_sound"))
    clock = last.groupBy(*keys).agg(F.max("_arrived").alias("_now"))
    none = F.col("_now") - F.col("_arrived")
    quiet = F.col("_now") - F.coalesce("_sound", "_first")
    told = last.join(clock, keys).withColumn("kind", F.when(none >= after, "none").when(quiet >= after, "zeros"))
    lasting = F.when(F.col("kind") == "none", none).otherwise(quiet)
    return told.where("kind is not null").select(*keys, source, "kind", F.floor(lasting + 0.5).cast("long").alias("seconds"))


LEVEL_STATE = "hop long, tail array<double>"


def hop_levels(blocks: DataFrame, key: str, order: str, pcm: str, hop: int, floor: float = 1e-10) -> DataFrame:
    """(key, i, db): the level of every whole hop of a stream of sample blocks, extended as
    sound comes. What a batch leaves of a hop is the state, so levels are those of the whole
    recording however it is cut. Also for a batch, of which an input is one group."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tail = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(order)
        x = np.concatenate([np.asarray(tail, float), *[np.asarray(v, float) for v in rows[pcm]]])
        n = len(x) // hop
        power = (x[: n * hop].reshape(n, hop) ** 2).mean(axis=1)
        state.update((int(at + n), x[n * hop :].tolist()))
        yield pd.DataFrame({key: [name[0]] * n, "i": np.arange(at, at + n), "db": 20 * np.log10(np.maximum(np.sqrt(power), floor))})

    kinds = dict(blocks.dtypes)
    return blocks.select(key, order, pcm).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, i long, db double", LEVEL_STATE, "append", GroupStateTimeout.NoTimeout)


def frames_of(frames: DataFrame, homes: DataFrame, keys: Keys, speaker: str = "speaker") -> DataFrame:
    """Voice frames (keys, t, src, prim, ...) that measure a speaker: those of their home
    input where ``homes`` (keys, speaker, home) has one, else each moment's primary ones. One
    row for each frame and each row of ``homes`` (home null: none)."""
    wanted = homes.select(*keys, speaker, "home")
    own = F.when(F.col("home").isNotNull(), F.col("src") == F.col("home")).otherwise(F.col("prim"))
    return frames.join(wanted, keys).where(own).drop("home")


def primary(frames: DataFrame, keys: Keys, loudness: str = "loudness") -> DataFrame:
    """``frames`` (keys, t, src, ...) with ``prim``: whether an input is the loudest of its
    moment; no loudness is the least, of equal inputs the first."""
    best = frames.groupBy(*keys, "t").agg(F.min_by("src", F.struct(-F.coalesce(F.when(~F.isnan(loudness), F.col(loudness)), F.lit(-1.0)), "src")).alias("_best"))
    return frames.join(best, [*keys, "t"]).withColumn("prim", F.col("src") == F.col("_best")).drop("_best")


def checked(recordings: DataFrame, shortest: float = 1.0, most: int = 20) -> DataFrame:
    """Recordings (duration, num_speakers) with ``error``, null where they can be analysed:
    under ``shortest`` seconds, or a number of speakers outside 1 to ``most``."""
    short = F.when(F.coalesce(F.col("duration"), F.lit(0.0)) < shortest, F.format_string("shorter than %s s", F.lit(f"{shortest:g}")))
    number = F.when((F.col("num_speakers") < 1) | (F.col("num_speakers") > most), F.format_string("the number of speakers is from 1 to %d", F.lit(most)))
    return recordings.withColumn("error", F.coalesce(short, number))
