"""Links inside index buckets and connected components, both distributed and exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.llm._tables import Shared, drop_shared, staged, write_shared

#: Members of a bucket that are compared in one piece; larger buckets are cut into
#: blocks of about this size and every pair of blocks becomes a piece of its own.
BLOCK = 256
#: Pairs compared at once in a Python worker.
_PAIRS = 1 << 19


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the given edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := parent.get(at, at)) != at:
            at = up
        while x != at:
            parent[x], x = at, parent.get(x, x)
        return at

    a_out, b_out = [], []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            a_out.append(a)
            b_out.append(b)
    return a_out, b_out


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places (i < j) of each group, about _PAIRS at once."""
    row_end = np.repeat(ends, ends - starts)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(starts) else np.zeros(0, np.int64)
    partners = row_end - 1 - rows
    group = np.cumsum(partners) // _PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        n = partners[x:y]
        left = np.repeat(rows[x:y], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        if len(left):
            yield left, right


def _stars(starts: np.ndarray, ends: np.ndarray, test: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each group's first member, and whether they join the whole group."""
    size = ends - starts
    left = np.repeat(starts, size - 1)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    hit = test(left, right) if len(left) else np.zeros(0, bool)
    linked = np.bincount(np.repeat(np.arange(len(starts)), size - 1), weights=hit, minlength=len(starts))
    return left[hit], right[hit], linked == size - 1


def _link_batches(batches: Iterator[pa.RecordBatch], link: Callable, stars: bool) -> Iterator[pa.RecordBatch]:
    def done(table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1)) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys)) if len(keys) else starts
        many = ends - starts > 1
        nodes = table.column("node").to_numpy()
        test = link(table)
        if stars and many.any():
            left, right, whole = _stars(starts[many], ends[many], test)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[left], pa.int64()), pa.array(nodes[right], pa.int64())], ["a", "b"])
            many[np.flatnonzero(many)[whole]] = False
        for left, right in _pairs(starts[many], ends[many]):
            hit = test(left, right)
            a, b = spanning(nodes[left[hit]], nodes[right[hit]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows < 8192:
            continue
        held = held.combine_chunks()
        keys = np.stack([held.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from done(held.slice(0, cut).combine_chunks(), keys[:cut])
            held = held.slice(cut)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield from done(held, np.stack([held.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1))


def shared_keys(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``index`` whose ``key`` two or more rows have, each once for every piece
    (``key``, ``lo``, ``hi``) in which it is to be compared. A bucket of n rows becomes
    about (n / block)^2 / 2 pieces of at most about 2 * block rows, so no bucket, however
    large, meets in one task and no pair is left out."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cut = index.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("size", "blocks", "own", "other")


def bucket_edges(index: DataFrame, link: Callable, block: int = BLOCK) -> DataFrame:
    """Verified links among rows that share a key, as spanning forests of each piece.

    ``index``: key long, node long and what ``link`` reads. ``link(table)`` returns a
    function of two arrays of row numbers that says which of the pairs are linked.
    """
    return piece_edges(shared_keys(index, block), link)


def piece_edges(pieces: DataFrame, link: Callable, stars: bool = False) -> DataFrame:
    """The same of rows that ``shared_keys`` has dealt into pieces. ``stars``: a piece whose
    first row is linked to all others needs no other pairs."""
    dealt = pieces.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(lambda batches: _link_batches(batches, link, stars), "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; the component is its
    smallest node. Alternating large-star and small-star steps, each a grouped minimum
    and a join, until no edge changes; the edges of each round are written to the shared
    folder. No edges: no rows."""
    spark = edges.sparkSession
    # smaller end in v, larger end in u
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path: Shared | None = None
    last = None
    while True:
        new = write_shared(now, "edges")
        if path is not None:
            drop_shared(spark, path)
        path = new
        edge = spark.read.schema("u long, v long").parquet(path)
        state = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    roots = edge.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
    out = staged(found, "components")
    drop_shared(spark, path)
    return out
