"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its word shingles. Documents are read in
windows as long as the items, one from each word; the fingerprints of windows are looked
up in a multi-index of the items' fingerprints: of four 16-bit blocks one differs by at most
three bits within the radius of 15. The index holds every block with up to two bits turned,
a window asks for its blocks with up to one, so equality finds all fingerprints within the
radius and about a twentieth of the rest. The weighted shingle similarity then verifies
each candidate. A window of which less than the wanted share of shingles stands
in any item cannot reach the similarity with any of them and needs no fingerprint.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
#: Items that are indexed and sent to the executors at once; more are taken in turns, each
#: turn reading all documents.
ITEMS_AT_ONCE = 20_000
#: Blocks of a fingerprint, and how many of a block's differing bits a window turns; the
#: index turns the others.
BLOCKS, ASKED_BITS = 4, 1
_FILTER_BITS = 20
#: Windows looked up at once.
_ASKED = 1 << 12
#: Words of a document whose windows are fingerprinted at once.
_REGION = 1 << 15


class Items:
    """Index of a bounded set of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, radius: int = RADIUS):
        self.shingle, self.radius = shingle, radius
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        flat, starts = _words.split(texts, lower=True)
        codes, words = _words.coded(flat)
        hashes = _words.word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
        self.groups: dict[int, dict[int, list[int]]] = {}  # shingle size -> words -> items
        self.ids = [i for i, _ in items]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # sorted distinct shingles, counts
        fingerprints = []
        for k in range(len(items)):
            own = hashes[starts[k] : starts[k + 1]]
            n = len(own)
            if n:
                size = min(shingle, n)
                self.groups.setdefault(size, {}).setdefault(n, []).append(k)
                grams = _words.gram_hashes(own, size)
            else:
                grams = hashes[:0]
            self.grams.append(np.unique(grams, return_counts=True))
            fingerprints.append(simhash(grams, np.array([0, len(grams)]))[0] if n else np.uint64(0))
        self.fingerprints = np.array(fingerprints, np.uint64)
        n_blocks = max(2, min(BLOCKS, radius + 1))
        cuts = [64 * k // n_blocks for k in range(n_blocks + 1)]
        # if every block differed by more than its bits, all would by more than the radius
        spare = max(0, radius + 1 - n_blocks)
        self.blocks = [(low, high - low, spare // n_blocks + (k < spare % n_blocks)) for k, (low, high) in enumerate(itertools.pairwise(cuts))]
        self.vocabulary = {size: np.unique(np.concatenate([self.grams[k][0] for ks in by.values() for k in ks])) for size, by in self.groups.items()}
        self.filters = {}
        for size, known in self.vocabulary.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.filters[size] = bits

    @functools.cached_property
    def index(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """For each shingle size and block the keys of the items, some bits turned, in order.
        Made where it is used and not sent."""
        out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, by in self.groups.items():
            which = np.array([k for ks in by.values() for k in ks], np.int32)
            length = np.array([n for n, ks in by.items() for _ in ks], np.int64)
            out[size] = []
            for block, (_, width, bits) in enumerate(self.blocks):
                turns = turned(width, max(0, bits - ASKED_BITS))
                keys = (self._key(self.fingerprints[which], length, block)[:, None] ^ turns).ravel()
                order = np.argsort(keys, kind="stable")
                out[size].append((keys[order], which[order // len(turns)]))
        return out

    def _key(self, fingerprints: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
        shift, width, _ = self.blocks[block]
        value = (fingerprints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        return (lengths << width) | value.astype(np.int64)

    def known(self, grams: np.ndarray, size: int) -> np.ndarray:
        """Which shingles some item has."""
        out = self.filters[size][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        vocabulary = self.vocabulary[size]
        at = np.searchsorted(vocabulary, grams[maybe]).clip(max=len(vocabulary) - 1)
        out[maybe] = vocabulary[at] == grams[maybe]
        return out

    def fetched(self, fingerprints: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, items) that equal keys of a block fetch; pairs may come again."""
        for (keys, which), block in zip(self.index[size], range(len(self.blocks)), strict=True):
            _, width, bits = self.blocks[block]
            turns = turned(width, min(bits, ASKED_BITS))
            own = (self._key(fingerprints, lengths, block)[:, None] ^ turns).ravel()
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            n = high - low
            at = np.repeat(np.arange(len(own)), n)
            yield at // len(turns), which[np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]

    def candidates(self, fingerprints: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, items): windows and items of their length within the radius. Equality of
        a block finds the pairs, the full distance confirms them; each pair comes once."""
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(fingerprints), _ASKED):
            some = fingerprints[a : a + _ASKED]
            for at, item in self.fetched(some, lengths[a : a + _ASKED], size):
                near = np.bitwise_count(some[at] ^ self.fingerprints[item]) <= self.radius
                found.append(np.unique((a + at[near]) * len(self.ids) + item[near]))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)

    def similarity(self, grams: np.ndarray, item: int) -> float:
        """Weighted Jaccard: shingles count as often as they stand in the text."""
        known, count = self.grams[item]
        if not len(grams) or not len(known):
            return 0.0
        own, times = np.unique(grams, return_counts=True)
        at = np.searchsorted(known, own).clip(max=len(known) - 1)
        same = known[at] == own
        both = np.minimum(times[same], count[at[same]]).sum()
        return float(both / (times.sum() + count.sum() - both))


@functools.cache
def turned(width: int, most: int) -> np.ndarray:
    """Every value of ``width`` bits of which at most ``most`` are set."""
    chosen = (bits for n in range(most + 1) for bits in itertools.combinations(range(width), n))
    return np.array([sum(1 << b for b in bits) for bits in chosen], np.int64)


def simhash(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of the shingles between consecutive bounds (none empty)."""
    bits = np.unpackbits(_words.mix(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    ones = total[bounds[1:]] - total[bounds[:-1]]
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def window_simhash(grams: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of ``count`` shingles from each of ``starts``; the windows may overlap."""
    bits = np.unpackbits(_words.mix(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    ones = total[starts + count] - total[starts]
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _document_hits(hashes: np.ndarray, items: Items, similarity: float, marks: dict[int, np.ndarray]) -> list[tuple[int, float, int, int]]:
    """(item, best similarity, first word, words) for one document. ``marks``: for each
    shingle size the places whose shingle some item has."""
    best: dict[int, tuple[float, int, int]] = {}
    total = len(hashes)
    for size, by_length in items.groups.items():
        at = marks.get(size)
        if at is None or not len(at):
            continue
        starts, lengths = [], []
        for n in by_length:
            # windows of n words (the whole text if it is shorter) that hold a marked place
            span = min(n, total)
            if span < size:
                continue
            low = np.maximum(at - (span - size), 0)
            high = np.minimum(at, total - span)
            low = np.maximum(low, np.concatenate(([0], np.maximum.accumulate(high)[:-1] + 1)))
            held = np.maximum(high - low + 1, 0)
            windows = np.repeat(low, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            shared = np.searchsorted(at, windows + span - size, "right") - np.searchsorted(at, windows)
            windows = windows[shared >= similarity * (span - size + 1) - 1e-9]
            starts.append(windows)
            lengths.append(np.full(len(windows), n))
        if not sum(map(len, starts)):
            continue
        start, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(start, kind="stable")
        start, length = start[order], length[order]
        cuts = [0, *(np.flatnonzero(np.diff(start // _REGION)) + 1).tolist(), len(start)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            first, n = start[a:b], length[a:b]
            span = np.minimum(n, total)
            base = int(first[0])
            grams = _words.gram_hashes(hashes[base : int((first + span).max())], size)
            count = span - size + 1
            places, found = items.candidates(window_simhash(grams, first - base, count), n, size)
            for k in np.unique(found).tolist():
                near = places[found == k]
                inside = np.concatenate(([0], np.cumsum(np.isin(grams, items.grams[k][0]))))
                w = first[near] - base
                both = inside[w + count[near]] - inside[w]
                # shared shingles bound the similarity from above
                enough = both >= similarity * np.maximum(items.grams[k][1].sum(), count[near]) - 1e-9
                for j, c, words in zip(w[enough].tolist(), count[near][enough].tolist(), span[near][enough].tolist(), strict=True):
                    s = items.similarity(grams[j : j + c], k)
                    if s >= similarity - 1e-12 and (k not in best or (s, -(base + j)) > (best[k][0], -best[k][1])):
                        best[k] = (s, base + j, words)
    return [(k, *found) for k, found in sorted(best.items())]


_HIT = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _hits(texts: pa.Array, items: Items, similarity: float) -> list[list[dict]]:
    """Matches of every text."""
    flat, starts = _words.split(texts, lower=True)
    codes, words = _words.coded(flat)
    hashes = _words.word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    marked: dict[int, dict[int, np.ndarray]] = {}
    for size in items.groups:
        places = _words.gram_places(starts, size, len(hashes))
        if not len(places):
            continue
        found = places[items.known(_words.gram_hashes(hashes, size)[places], size)]
        owner = np.searchsorted(starts, found, "right") - 1
        for d in np.unique(owner).tolist():
            marked.setdefault(d, {})[size] = found[owner == d] - starts[d]
    for d, marks in marked.items():
        for k, s, first, n in _document_hits(hashes[starts[d] : starts[d + 1]], items, similarity, marks):
            out[d].append({"item_id": items.ids[k], "similarity": s, "first_word": first, "n_words": n})
    return out


def _turns(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Items]:
    """Indexes of ITEMS_AT_ONCE items each. The benchmark is a table of test items: it is
    read in turns, so what is sent to the executors has a fixed bound."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    held: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == ITEMS_AT_ONCE:
            yield Items(held)
            held = []
    if held:
        yield Items(held)


_LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _listed(items: Items, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches):
            found = _hits(_words.as_text(piece.column(1)), items, similarity)
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = pa.array([h for x in found for h in x], _HIT)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), *flat.flatten()], ["doc_id", *[f.name for f in _HIT]])

    return run


def _without(items: Items, similarity: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _words.text_of(("_row", text_col))
        for piece in _words.slices(batches, ("_row", text_col)):
            keep = [not x for x in _hits(_words.as_text(read(piece)), items, similarity)]
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(keep))], ["_row"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each document and item the
    best window of the item's length whose weighted similarity reaches ``similarity``.

    Words are lower-cased (A-Z). Texts shorter than an item are one window. Items and texts
    of fewer than five words are one shingle; null and word-free ones match nothing. Rows
    with a null id and repeated rows are searched like any other; empty tables give no rows;
    other columns are not read. No shuffle.
    """
    found = None
    for items in _turns(benchmark, item_id, item_text):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_listed(items, similarity), _LEAKS)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window matches an item. No shuffle."""
    for items in _turns(benchmark, item_id, item_text):
        rows = docs.select(F.struct("*").alias("_row"))
        kept = rows.mapInArrow(_without(items, similarity, text_col), rows.schema)
        docs = kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return docs
