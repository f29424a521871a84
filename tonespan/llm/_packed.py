"""Arrays of numbers as compressed bytes, and the buckets of a range of hashes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Bytes of the values, low bytes of all first, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    """Floats of which many are equal: the distinct ones once, and which each is."""
    distinct, code = np.unique(np.asarray(values, np.float64), return_inverse=True)
    return len(distinct).to_bytes(8, "little") + pack(np.concatenate((distinct.view(np.uint64), code.astype(np.uint64))))


def unpack_values(data: bytes) -> np.ndarray:
    n, found = int.from_bytes(data[:8], "little"), unpack(data[8:])
    return found[:n].view(np.float64)[found[n:].astype(np.int64)]


def pack_words(words: list[str]) -> bytes:
    """Words, none of which holds a line break."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split("\n") if text else []


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins in sorted hashes."""
    limits = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(hashes, np.array(limits, np.uint64)), [len(hashes)]))
