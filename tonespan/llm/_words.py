"""Vectorised words: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once in a Python worker; a longer document is its own slice.
SLICE_BYTES = 3 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    flat: pa.Array  # every word of every text, in order
    starts: np.ndarray  # int64, len(texts) + 1: where each text's words begin


def as_text(column) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    # ascii_lower needs offsets that begin at 0; joining copies the slice
    return pa.concat_arrays([texts, texts.slice(0, 0)])


def trim() -> None:
    """Give free memory back, so that a worker that is kept for later tasks stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def text_of(column: str | tuple[str, str]) -> Callable[[pa.RecordBatch], pa.Array]:
    """Reader of a column of a batch, or of a field of a struct column."""

    def read(batch: pa.RecordBatch) -> pa.Array:
        name, field = (column, None) if isinstance(column, str) else column
        found = batch.column(batch.schema.get_field_index(name))
        return found if field is None else found.field(found.type.get_field_index(field))

    return read


def slices(batches: Iterator[pa.RecordBatch], column: str | tuple[str, str] = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``limit`` bytes of text."""
    read = text_of(column)
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(read(batch)), 0)
        group = (np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) - 1).clip(0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    trim()


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; ``lower`` maps A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        before = np.concatenate(([0], np.cumsum(~empty)))
        flat, starts = flat.filter(pa.array(~empty)), before[starts]
    return Words(flat, starts)


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the words and the words that the codes stand for."""
    if not len(flat):
        return np.zeros(0, np.int64), []
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of 64-bit hashes."""
    with np.errstate(over="ignore"):
        return mix(mix(left + _GOLDEN) * np.uint64(3) + right)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = pair_hash(out, hashes[k : len(hashes) - n + 1 + k])
    return out


def owners(starts: np.ndarray) -> np.ndarray:
    """For each flat place the text it lies in."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def gram_places(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places from which n words lie in one text."""
    keep = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        ends = starts[1:] - back
        keep[ends[(ends >= 0) & (ends < len(keep))]] = False
    return np.flatnonzero(keep)
