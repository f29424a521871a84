"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text moves on by one or two at each step; a random bit that
all texts share, of the step's number and the character's class, says which. Texts that
differ by an insertion walk apart there and, as a difference of places is a random walk of
its own, soon meet again: from there on they pass the same characters at the same steps. So
edit distance becomes Hamming distance between the sequences of what is passed. Of those
steps, spread over the whole walk, a fixed number is sampled, the same ones for walks of the
same length, and a few bits of the characters passed there are the fingerprint. Bands of
sampled bits find near fingerprints by equality joins; the whole fingerprints decide.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._graph import connected_components, piece_edges, shared_keys
from tonespan.llm._tables import drop, release, staged

#: Sampled steps of a fingerprint, each of four bits (a hexadecimal digit).
SAMPLES = 128
#: Characters that a sample sees.
WIDTH = 3
#: Likeness from which two fingerprints are linked, bands and samples of a band. At that
#: likeness a band agrees with probability 0.81^10, one of 40 with 0.994.
NEAR, BANDS, BAND_SAMPLES = 0.8, 40, 10
#: Rows of a band's bucket that are compared in one piece.
BLOCK = 4096
#: The shared bits repeat after so many steps.
_PERIOD = 4096
#: Steps between two looks at which samples were passed.
_STRIDE = 1 << 14
_MASK = (1 << 64) - 1


@functools.cache
def _bits() -> list[bytes]:
    """Moves (1 or 2) of each class of characters at each step of a period."""
    x = _words.mix(np.arange(1, 256 * _PERIOD + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [row.tobytes() for row in (1 + (x >> np.uint64(63))).astype(np.uint8).reshape(256, _PERIOD)]


@functools.cache
def _records(chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(sample, step) in order of steps, for the steps of one stride at which a sample's
    random rank falls below all ranks before: the last such step of a walk is its sample."""
    best = _least(chunk)
    steps = np.arange(chunk * _STRIDE, (chunk + 1) * _STRIDE, dtype=np.uint64)
    found = []
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            rank = _words.mix(_words.mix(steps + np.uint64(1)) + np.uint64(k) * np.uint64(0xD1B54A32D192ED03))
            low = np.minimum.accumulate(np.concatenate(([best[k]], rank)))
            at = np.flatnonzero(low[1:] < low[:-1])
            found.append(np.stack((np.full(len(at), k), at + chunk * _STRIDE)))
    samples, steps = np.concatenate(found, axis=1)
    order = np.argsort(steps, kind="stable")
    return samples[order], steps[order]


@functools.cache
def _least(chunk: int) -> np.ndarray:
    """Each sample's least rank before a stride."""
    if not chunk:
        return np.full(SAMPLES, np.uint64(_MASK))
    before = _least(chunk - 1)
    steps = np.arange((chunk - 1) * _STRIDE, chunk * _STRIDE, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.array([min(before[k], _words.mix(_words.mix(steps + np.uint64(1)) + np.uint64(k) * np.uint64(0xD1B54A32D192ED03)).min()) for k in range(SAMPLES)], np.uint64)


class Walk(NamedTuple):
    """Where a walk stands: its next step, its place, and the place of each sample so far."""

    step: int
    place: int
    samples: np.ndarray


def start() -> Walk:
    return Walk(0, 0, np.zeros(SAMPLES, np.int64))


def walk(classes: bytes, stop: int, at: Walk) -> Walk:
    """Go on from ``at`` until the place is ``stop`` or more."""
    bits, samples = _bits(), at.samples.copy()
    step, place = at.step, at.place
    while place < stop:
        chunk = step // _STRIDE
        first, last, passed = step, (chunk + 1) * _STRIDE, []
        for turn in range(step, last):
            if place >= stop:
                break
            passed.append(place)
            place += bits[classes[place]][turn & (_PERIOD - 1)]
        step = first + len(passed)
        of, steps = _records(chunk)
        own = slice(np.searchsorted(steps, first), np.searchsorted(steps, step))
        # several records of one sample: the last one counts
        samples[of[own]] = np.array(passed, np.int64)[steps[own] - first]
    return Walk(step, place, samples)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(points: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def digits(points: np.ndarray, samples: np.ndarray) -> str:
    """Four bits of the characters that each sample sees (past the end: zero)."""
    seen = np.concatenate((points, np.zeros(WIDTH, np.uint32))).astype(np.uint64)
    x = np.arange(SAMPLES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            x = _words.mix(x * np.uint64(0x9E3779B97F4A7C15) + seen[samples + k] + np.uint64(1))
    nibble = (x >> np.uint64(60)).astype(np.uint8)
    return (nibble[::2] << 4 | nibble[1::2]).astype(np.uint8).tobytes().hex()


class Printed(NamedTuple):
    """A text's fingerprint, and its walk where the half that edited texts keep ends."""

    text: str
    fingerprint: str
    half: Walk


def printed(text: str) -> Printed:
    """Of an empty text the fingerprint is all zeros."""
    if not text:
        return Printed(text, "0" * SAMPLES, start())
    points = code_points(text)
    classes = _classes(points)
    half = walk(classes, len(text) - len(text) // 2 - 1, start())
    return Printed(text, digits(points, walk(classes, len(text), half).samples), half)


def fingerprint(text: str) -> str:
    """Hexadecimal fingerprint of a whole text."""
    return printed(text).fingerprint


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_print(own: Printed, edited: str) -> str:
    """Fingerprint of the edited text: the walk goes on from where both are still equal."""
    if not edited:
        return "0" * SAMPLES
    points = code_points(edited)
    return digits(points, walk(_classes(points), len(edited), own.half).samples)


def likeness(left: str, right: str) -> float:
    """Share of equal samples, less what chance makes equal: 1 for equal fingerprints."""
    return float(_likeness(np.array([_nibbles(left)]), np.array([_nibbles(right)]))[0])


def _nibbles(fp: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fp), np.uint8)
    return np.stack((raw >> 4, raw & 15), axis=1).ravel()


def _likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (16 * (left == right).mean(axis=1) - 1) / 15)


_OUT = "kind string, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [f.strip().split() for f in _OUT.split(",")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _KINDS[kind]) for name, kind in _FIELDS], [name for name, _ in _FIELDS])


def _row(doc_id: int | None, own: Printed, following: Printed) -> dict:
    edited = edited_text(own.text, following.text)
    other = edited_print(own, edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return {"kind": "row", "doc_id": doc_id, "n_chars": len(own.text), "edited_sha256": digest, "fingerprint": own.fingerprint, "edited_fingerprint": other, "near_edited": likeness(own.fingerprint, other), "near_next": likeness(own.fingerprint, following.fingerprint)}


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row, staged.

    The edited text has its last half replaced by the beginning of the next document's, in
    ascending order of ids (after the last: the first). Null texts are empty; null ids come
    first, equal ids in the order of a hash of their texts; repeated rows follow each other
    and come back repeated; a single document is its own next one; an empty table gives an
    empty one; other columns are not read.

    Texts move once, into ranges of ids. A range knows all next documents but its last
    one's, which is the first of the next range that has rows: those two rows of each range
    meet afterwards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    # whole repeated rows would be one range, but for the number of the row
    ordered = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple[int | None, Printed] | None = None
        for piece in _words.slices(batches, "text"):
            out = []
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                own = printed(text)
                if held is None:
                    out.append({"kind": "first", "part": part, "doc_id": doc_id, "text": text})
                else:
                    out.append(_row(*held, own))
                held = (doc_id, own)
            yield _batch(out)
        if held is not None:
            yield _batch([{"kind": "last", "part": part, "doc_id": held[0], "text": held[1].text}])
        _words.trim()

    found = staged(ordered.mapInArrow(run, _OUT), "edit-prints")
    release(spark)
    # one number for each range of ids
    used = [r[0] for r in found.where("kind = 'first'").select("part").orderBy("part").collect()]
    if not used:
        return found.drop("kind", "part", "text")
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, after int")
    last = found.where("kind = 'last'").join(after, "part").select("doc_id", "text", F.col("after").alias("part"))
    first = found.where("kind = 'first'").select("part", F.col("text").alias("following"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, after = (batch.column(c)[k].as_py() for c in range(3))
                yield _batch([_row(doc_id, printed(text), printed(after))])

    closing = last.join(first, "part").select("doc_id", "text", "following").mapInArrow(edges, _OUT)
    return found.where("kind = 'row'").unionByName(staged(closing, "edit-prints-last")).drop("kind", "part", "text")


@functools.cache
def _band_samples(bands: int, size: int) -> np.ndarray:
    """Samples of each band."""
    rng = np.random.Generator(np.random.PCG64(12))
    return np.stack([rng.choice(SAMPLES, size, replace=False) for _ in range(bands)])


def near_groups(prints: DataFrame, near: float = NEAR, bands: int = BANDS, size: int = BAND_SAMPLES) -> DataFrame:
    """(fingerprint, group) of the distinct fingerprints in ``prints``; fingerprints are
    linked from a likeness of ``near``, the group is the least fingerprint that links lead
    to. Bands find a pair at that likeness with probability 0.994 (more above); equal
    fingerprints are one node. ``prints`` is read twice."""
    # nodes are numbered, so no two fingerprints are taken for one
    nodes = staged(prints.select("fingerprint").distinct().withColumn("node", F.monotonically_increasing_id()), "print-nodes")
    samples = _band_samples(bands, size)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(size, dtype=np.uint64) * np.uint64(4)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                fp = np.stack([_nibbles(x) for x in part.column(0).to_pylist()]).astype(np.uint64)
                for b in range(bands):
                    with np.errstate(over="ignore"):
                        key = _words.mix(np.bitwise_or.reduce(fp[:, samples[b]] << shift, axis=1) + np.uint64(b) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(key.view(np.int64))], ["node", "key"])

    def link(table: pa.Table):
        # a hexadecimal digit is a sample
        fp = np.stack([np.frombuffer(x, np.uint8) for x in table.column("fingerprint").cast(pa.binary()).to_pylist()])
        return lambda left, right: (16 * (fp[left] == fp[right]).mean(axis=1) - 1) / 15 >= near

    index = nodes.mapInArrow(banded, "node long, key long")
    pieces = shared_keys(index, BLOCK).join(nodes, "node")
    components = connected_components(piece_edges(pieces, link, stars=True))
    of = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("fingerprint").alias("group"))
    grouped = staged(of.join(least, "component").select("fingerprint", "group"), "print-groups")
    drop(nodes)
    return grouped
