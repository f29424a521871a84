"""Who counts as a speaker, one regrouping after another: confirmed when a voice holds,
dropped when it fades; and windows that still lack voiceprints, a few at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonespan.streaming.scan import scan

Keys = list[str]
# Talk and share of all talk that confirm, the shortest turn, below which a
# speaker is weak, after how many regroupings one is dropped, windows printed at once.
CONFIRM_TALK, CONFIRM_SHARE, SHORTEST_TURN, DROP_TALK, DROP_SHARE, DROP_AFTER, AT_ONCE = 2.0, 0.05, 0.8, 3.0, 0.03, 2, 2


class Confirmation:
    """The speakers of one session."""

    def __init__(self, seen: dict | None = None, confirmed: dict | None = None, weak: dict | None = None, order: int = 0):
        self.seen, self.confirmed, self.weak, self.order = seen or {}, confirmed or {}, weak or {}, order

    def round(self, voices: list[tuple]) -> list[tuple]:
        """Take (speaker, talk, longest, first, own) of each voice of a regrouping, and give
        (speaker, order, number) of those that count now: the order in which they were
        confirmed, and that order with gaps closed."""
        voices = sorted(voices, key=lambda v: (v[3], v[0]))
        total = sum(v[1] for v in voices)
        self.seen = {v[0]: self.seen.get(v[0], 0) + 1 for v in voices}
        own = {v[0] for v in voices if v[4]}
        talk = {v[0]: v[1] for v in voices}
        # of equal talkers the first to appear talks most
        most = max(voices, key=lambda v: v[1])[0] if voices else None
        for k in list(self.confirmed):
            strong = talk.get(k, 0.0) >= DROP_TALK and talk.get(k, 0.0) >= DROP_SHARE * total
            if k in own or k == most or strong:
                self.weak.pop(k, None)
                continue
            self.weak[k] = self.weak.get(k, 0) + 1
            if self.weak[k] >= DROP_AFTER:
                del self.confirmed[k], self.weak[k]
        anyone = any(k in self.confirmed for k in talk)
        for k, seconds, longest, _, mine in voices:
            if k in self.confirmed or longest < SHORTEST_TURN:
                continue
            if not mine and (seconds < CONFIRM_TALK or (anyone and seconds < CONFIRM_SHARE * total)):
                continue
            if self.seen[k] >= 2 or not anyone or mine:
                self.confirmed[k] = self.order
                self.order += 1
                anyone = True
        shown = sorted(self.confirmed.items(), key=lambda x: x[1])
        return [(k, order, number) for number, (k, order) in enumerate(shown)]


class _Rounds:
    """Rows of a session in order of rounds."""

    def __init__(self):
        self.one, self.now, self.voices = Confirmation(), None, []

    def _close(self) -> list[tuple]:
        return [(self.now, *r) for r in self.one.round(self.voices)] if self.voices else []

    def step(self, number, speaker, talk, longest, first, own) -> list[tuple]:
        out = []
        if number != self.now:
            out, self.now, self.voices = self._close(), number, []
        self.voices.append((speaker, talk, longest, first, bool(own)))
        return out

    def end(self) -> list[tuple]:
        return self._close()


VOICE = ["round", "speaker", "talk", "longest", "first", "own"]


def confirmed(rounds: DataFrame, keys: Keys) -> DataFrame:
    """(keys, round, speaker, order, number) of everyone who counts after each round.
    ``rounds``: (keys, round, speaker, talk, longest, first, own), every voice of each
    regrouping. A session streams through; its speakers are the state."""
    kinds = dict(rounds.dtypes)
    return scan(rounds, keys, ["round", "first", "speaker"], VOICE, lambda _: _Rounds(), f"round {kinds['round']}, speaker {kinds['speaker']}, order int, number int")


class _Stream(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("speakers", "speaker array<long>, seen array<int>, placed array<int>, weak array<int>, next int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        one = Confirmation()
        if self.state.exists():
            speakers, seen, placed, weak, order = self.state.get()
            # minus one: not confirmed; zero: not seen last, not weak
            one = Confirmation(*({s: v for s, v in zip(speakers, values, strict=True) if v > least} for values, least in ((seen, 0), (placed, -1), (weak, 0))), order)
        out = []
        for number, voices in pd.concat(list(rows)).groupby("round", sort=True):
            found = list(voices[VOICE[1:]].itertuples(index=False, name=None))
            out += [(key[0], number, *r) for r in one.round(found)]
        known = sorted({*one.seen, *one.confirmed, *one.weak})
        self.state.update((known, *([held.get(s, none) for s in known] for held, none in ((one.seen, 0), (one.confirmed, -1), (one.weak, 0))), one.order))
        yield pd.DataFrame(out, columns=[self.key, "round", "speaker", "order", "number"])

    def close(self) -> None:
        pass


def confirmed_stream(rounds: DataFrame, key: str) -> DataFrame:
    """The streaming form; a round comes whole, in one batch. Speakers are whole numbers.
    Needs the RocksDB state store."""
    kinds = dict(rounds.dtypes)
    schema = f"{key} {kinds[key]}, round {kinds['round']}, speaker long, order int, number int"
    return rounds.groupBy(key).transformWithStateInPandas(_Stream(key), schema, "Append", "None")


def backlog(windows: DataFrame, keys: Keys, missing, at_once: int = AT_ONCE) -> DataFrame:
    """(keys, chunk, turn): in which turn each window without voiceprints gets them: the
    oldest first, up to ``at_once`` that follow each other in one turn. The first turn is
    what a batch takes now."""
    lacking = windows.where(missing).select(*keys, "chunk").distinct()
    w = Window.partitionBy(*keys).orderBy("chunk")
    run = lacking.withColumn("_run", F.col("chunk") - F.row_number().over(w))
    place = run.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("chunk")) - 1)
    begins = F.when(F.col("_p") % at_once == 0, 1).otherwise(0)
    return place.select(*keys, "chunk", (F.sum(begins).over(w) - 1).cast("int").alias("turn"))


def solo(grouped: DataFrame, keys: Keys, known: DataFrame) -> DataFrame:
    """(keys, speaker): with one speaker, who that is: the one who talks most in what is
    grouped so far, else the least number that ``known`` (keys, speaker) does not have."""
    talk = grouped.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_talk"))
    most = talk.groupBy(*keys).agg(F.min_by("speaker", F.struct(-F.col("_talk"), "speaker")).alias("_most"))
    new = known.groupBy(*keys).agg((F.coalesce(F.max("speaker"), F.lit(-1)) + 1).alias("_new"))
    return new.join(most, keys, "full").select(*keys, F.coalesce("_most", "_new", F.lit(0)).cast("long").alias("speaker"))
