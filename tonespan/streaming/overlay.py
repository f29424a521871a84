"""What labels hold now: the latest regrouping, own-track runs and online labels past it,
laid over each other, and looked up when frames are read."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.operators import spans, timeline
from tonespan.streaming.scan import scan

Keys = list[str]
#: Order in which labels hold: the least number first.
GROUPED, OWN, ONLINE = 0, 1, 2


def layers(grouped: DataFrame, own: DataFrame, online: DataFrame, until: DataFrame, keys: Keys) -> DataFrame:
    """(keys, start, end, speaker, generation) of all labels that still hold.

    ``until``: (keys, until), how far the regrouping has seen, none for keys without one. Own
    and online labels hold from there on; those that end before are superseded, those that
    reach across are cut. A speaker with an input of their own has no online labels.
    """
    columns = [*keys, "start", "end", "speaker"]
    since = F.coalesce("until", F.lit(0.0))

    def tail(rows: DataFrame, generation: int) -> DataFrame:
        later = rows.select(*columns).join(until.select(*keys, "until"), keys, "left").where(F.col("end") > since)
        return later.select(*keys, F.greatest("start", since).alias("start"), "end", "speaker", F.lit(generation).alias("generation"))

    others = online.join(own.select(*keys, "speaker").distinct(), [*keys, "speaker"], "left_anti")
    return grouped.select(*columns, F.lit(GROUPED).alias("generation")).unionByName(tail(own, OWN)).unionByName(tail(others, ONLINE))


def current_labels(held: DataFrame, keys: Keys, gap: float = 0.3) -> DataFrame:
    """(keys, speaker, start, end): each speaker's labels of all generations, joined across
    short gaps; speakers who talk at once overlap."""
    return spans.gap_join(held, [*keys, "speaker"], gap)


class _Sweep:
    """The intervals under way, best first; only they are kept."""

    def __init__(self):
        self.active: list[tuple] = []
        self.at = float("-inf")
        self.piece: tuple | None = None

    def _emit(self, start: float, end: float, label: tuple) -> list[tuple]:
        if self.piece and self.piece[1] == start and self.piece[2:] == label:
            self.piece = (self.piece[0], end, *label)
            return []
        out, self.piece = ([self.piece] if self.piece else []), (start, end, *label)
        return out

    def _advance(self, to: float) -> list[tuple]:
        out = []
        while self.active and self.at < to:
            generation, speaker, end = self.active[0]
            if end <= self.at:
                heapq.heappop(self.active)
                continue
            out += self._emit(self.at, min(end, to), (speaker, generation))
            self.at = min(end, to)
        self.at = max(self.at, to)
        return out

    def step(self, start: float, end: float, speaker, generation: int) -> list[tuple]:
        out = self._advance(start)
        heapq.heappush(self.active, (generation, speaker, end))
        return out

    def end(self) -> list[tuple]:
        out = self._advance(float("inf"))
        return out + ([self.piece] if self.piece else [])


def overlay(held: DataFrame, keys: Keys) -> DataFrame:
    """(keys, start, end, speaker, generation): disjoint pieces, at every moment the label of
    the first generation that has one (of its labels the least speaker). One sweep over the
    starts in order."""
    some = held.where("end > start")
    kind = dict(held.dtypes)["speaker"]
    columns = ["start", "end", "speaker", "generation"]
    return scan(some, keys, ["start"], columns, lambda _: _Sweep(), f"start double, end double, speaker {kind}, generation int")


def retag(frames: DataFrame, pieces: DataFrame, keys: Keys, at: str = "t") -> DataFrame:
    """``frames`` with the ``speaker`` and ``generation`` that hold at their time, null where
    nobody speaks. Pieces are disjoint, so a frame comes once."""
    found = timeline.asof(frames, pieces.select(*keys, "start", "end", "speaker", "generation"), keys, at, "start")
    inside = F.col(at) < F.col("end")
    return found.select(*frames.columns, *[F.when(inside, F.col(c)).alias(c) for c in ("speaker", "generation")])
