"""A pass over sorted rows that carries a small state from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are handed on at once.
ROWS = 4096


class Machine(Protocol):
    """What a pass keeps of one key."""

    def step(self, *row) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], begin: Callable[[tuple], Machine], schema: str) -> DataFrame:
    """Each key's rows, sorted by ``order``, through a machine of its own. Rows stream by: a
    task holds what the machine keeps and one batch, not the rows of a key. ``step`` gets
    ``columns``; what it and ``end`` return comes behind the keys, as ``schema`` says."""
    n = len(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    names = [f.strip().split()[0] for f in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if machine is None or row[:n] != now:
                    if machine is not None:
                        out.extend((*now, *r) for r in machine.end())
                    now, machine = row[:n], begin(row[:n])
                out.extend((*now, *r) for r in machine.step(*row[n:]))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if machine is not None:
            out.extend((*now, *r) for r in machine.end())
        if out:
            yield pd.DataFrame(out, columns=names)

    wanted = [*keys, *columns]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*wanted)
    return ordered.mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
