"""Inference windows of a live session: each goes out once its last block has arrived, and
gives only what no earlier one gave."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = "window long, pcm array<double>, heard long, fresh long"


class Windows:
    """The last blocks of one session."""

    def __init__(self, size: int, per: int, first: int = 0, held: list | None = None):
        self.size, self.per, self.first = size, per, first
        self.held: list[np.ndarray] = [np.asarray(x, float) for x in held or []]

    def _window(self) -> tuple:
        x = np.concatenate(self.held)
        heard = len(x)
        out = np.zeros(self.per * self.size)
        out[:heard] = x
        # the first window is new as a whole, of each later one its last block
        return self.first, out.tolist(), heard, heard if self.first == 0 else len(self.held[-1])

    def push(self, pcm) -> list[tuple]:
        """The next block in order; a window, if it is full."""
        if len(self.held) == self.per:
            self.held.pop(0)
            self.first += 1
        self.held.append(np.asarray(pcm, float))
        return [self._window()] if len(self.held) == self.per else []

    def finish(self) -> list[tuple]:
        """A session of fewer blocks than a window has one, filled up with silence."""
        return [self._window()] if self.held and len(self.held) < self.per else []


class _Stream(StatefulProcessor):
    def __init__(self, key: str, index: str, pcm: str, size: int, per: int):
        self.key, self.index, self.pcm, self.size, self.per = key, index, pcm, size, per

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("blocks", "first long, held array<array<double>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, held = self.state.get() if self.state.exists() else (0, [])
        one, out, ended = Windows(self.size, self.per, first, held), [], False
        for r in pd.concat(list(rows)).sort_values(["ended", self.index]).itertuples():
            if r.ended:
                out += one.finish()
                ended = True
            else:
                out += one.push(getattr(r, self.pcm))
        if ended:
            self.state.clear()
        else:
            self.state.update((one.first, [x.tolist() for x in one.held]))
        yield pd.DataFrame([(key[0], *w) for w in out], columns=[self.key, *[f.split()[0] for f in WINDOW.split(", ")]])

    def close(self) -> None:
        pass


def windows_stream(blocks: DataFrame, key: str, size: int, per: int, index: str = "block", pcm: str = "pcm") -> DataFrame:
    """(key, window, pcm, heard, fresh) of a stream of aligned blocks (key, index, pcm, ended),
    which come in order: the windows of ``halo.inference_windows``, each as soon as it is
    full. The last ``fresh`` of its ``heard`` samples are those that no earlier window gave.
    The state is one window. ``ended``: a last row without sound. Needs the RocksDB store."""
    kinds = dict(blocks.dtypes)
    return blocks.groupBy(key).transformWithStateInPandas(_Stream(key, index, pcm, size, per), f"{key} {kinds[key]}, {WINDOW}", "Append", "None")
