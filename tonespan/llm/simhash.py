"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within the radius
have a segment that differs by one bit at most. Each segment is indexed once for every
bit with that bit masked out, so an equality join on the masked values meets every such
pair; the full Hamming distance then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._graph import bucket_edges, connected_components
from tonespan.llm._tables import drop, free_name, release, staged

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints whose variants one task makes.
SPREAD = 20_000


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprint of each text."""
    flat, starts = _words.split(texts, lower=True)
    out = np.zeros(len(starts) - 1, np.uint64)
    if not len(flat):
        return out
    words = flat.cast(pa.large_binary()).to_pylist()
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = np.diff(starts)
    span = np.minimum(n, shingle)  # a short text is one shingle
    places = np.concatenate((_words.gram_places(starts, shingle, len(words)), starts[:-1][(n > 0) & (n < shingle)]))
    places.sort()
    last = places + span[np.searchsorted(starts, places, "right") - 1] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin[places].tolist(), end[last].tolist(), strict=True)), np.uint64, len(places))
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.cumsum(count) - count
    filled = np.flatnonzero(count)
    out[filled] = majority(h, first[filled])
    return out


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of texts of which shingle ``hashes`` begin at ``first``: a bit is set if
    over half of a text's hashes have it."""
    if not len(first):
        return np.zeros(0, np.uint64)
    count = np.diff(np.append(first, len(hashes)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def key_of(id_col: str, text_col: str):
    """Rows that agree in id and text are one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, key, fp longs) of every row; null and word-free texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "text", 1 << 20):
            fp = fingerprints_of(_words.as_text(piece.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key_of(id_col, text_col).alias("key"))
    return rows.mapInArrow(run, "id long, key long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs by one bit at most."""
    m = radius // 2 + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, node): one row for each bit of each segment of ``fp``, that bit masked out."""
    keys = []
    for shift, width in segments(radius):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else (1 << 63) - 1)) if width < 64 else F.col("fp")
        for bit in range(width):
            masked = segment.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1))
            keys.append(F.xxhash64(masked, F.lit(shift + bit)))
    return fps.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("key"))


def hamming_link(radius: int):
    def link(table: pa.Table):
        nodes = table.column("node").to_numpy().view(np.uint64)
        return lambda left, right: np.bitwise_count(nodes[left] ^ nodes[right]) <= radius

    return link


def linked_groups(distinct: DataFrame, radius: int, rows: int) -> DataFrame:
    """``distinct``, one row for each ``fp``, and its ``group`` by links within the radius. The
    index has 64 times the rows, so the fingerprints are spread over as many tasks as it needs."""
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // SPREAD)
    index = variants(distinct.select("fp").repartition(tasks, "fp"), radius)
    return grouped_by(distinct, connected_components(bucket_edges(index, hamming_link(radius))))


def grouped_by(distinct: DataFrame, near: DataFrame) -> DataFrame:
    """``distinct`` and its ``group`` by the components ``near``; the others are their own."""
    return distinct.join(near, distinct["fp"] == near["node"], "left").drop("node").withColumn("group", F.coalesce("component", "fp")).drop("component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long, component long) of every row of ``docs``.

    Rows are linked if their fingerprints differ in ``radius`` bits at most; the component
    is the smallest id that links lead to. Equal fingerprints are one node, so a group of
    exact copies costs one index entry. Null and word-free texts have fingerprint zero and
    are linked like any other; rows with a null id take part and take the component of
    their fingerprint (null if no row of it has an id); repeated rows come back repeated;
    an empty table gives an empty one; other columns of ``docs`` are not read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    grouped = linked_groups(distinct, radius, rows.count())
    lowest = grouped.groupBy("group").agg(F.min("least").alias("component"))
    named = grouped.join(lowest, "group").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, that near-duplicate groups keep: of each group the
    row with the smallest id (null last). Rows that agree in id and text are one document
    and one of them stays. Texts move once, to leave out the others."""
    prints = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    first = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "key")
    distinct = prints.groupBy("fp").agg(F.min(first).alias("first"))
    return without_copies(docs, id_col, text_col, prints, linked_groups(distinct, radius, prints.count()))


def without_copies(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the groups keep. ``prints``: staged (key, fp) of every row,
    not needed after; ``grouped``: (fp, first, group), ``first`` the least (id, key)."""
    own = free_name(docs, "_key")
    keyed = docs.withColumn(own, key_of(id_col, text_col))
    rows = prints.withColumnRenamed("key", own)
    kept = grouped.groupBy("group").agg(F.min("first").alias("kept"))
    decided = rows.join(grouped.join(kept, "group").select("fp", "kept"), "fp")
    gone = staged(decided.where(F.col(own) != F.col("kept.key")).select(own).distinct(), "removed")
    twice = staged(rows.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own), "repeated")
    drop(prints)
    release(docs.sparkSession)
    left = keyed.join(gone, own, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, own, "left_anti").unionByName(left.join(twice, own, "left_semi").dropDuplicates([own]))
    return left.select(*docs.columns)
