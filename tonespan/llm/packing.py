"""Packing token sequences by length patterns.

Token counts come from a public tokenizer. The histogram of piece lengths (at most
``capacity`` rows) goes to the driver, where non-negative least squares fits repeat counts
of few-document length patterns to it; the counts are rounded, what they leave is fitted
again, and the pieces that no pattern takes are packed best-fit, longest first, by length
and count. The plan's size depends on the capacity and not on the corpus. Each piece then finds its place from its rank among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._tables import staged

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBER = 1_200_000
#: Fits of patterns, each to what those before have left, and the fitted repeats from which
#: a pattern is taken once at least.
FITS, TAKEN_FROM = 12, 0.02
#: Shares of the patterns that are tried to be opened for the pieces that are left.
OPENED = (0, 0.05, 0.1, 0.2, 0.3, 0.4)
#: Pieces of one length that are ranked together.
RANKED = 400

_SEPARATOR = "<|endoftext|>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of words by a tokenizer that drops white space between words, so that a text's
    ids are those of its words in order. Each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.n = np.zeros(0, np.uint32)
        self.flat = np.zeros(0, self.kind)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        plain = self.separator is not None
        out, n = [], []
        for a in range(0, len(words), 1000):
            group = words[a : a + 1000]
            if plain and not any("<|" in w for w in group):
                ids = np.array(self.tokenizer.encode(_SEPARATOR.join(group), add_special_tokens=False).ids, np.uint32)
                cut = np.flatnonzero(ids == self.separator)
                if len(cut) == len(group) - 1:
                    edges = np.concatenate(([-1], cut, [len(ids)]))
                    out.append(np.delete(ids, cut))
                    n.append(np.diff(edges) - 1)
                    continue
            each = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            out.append(np.array([i for x in each for i in x], np.uint32))
            n.append(np.array([len(x) for x in each], np.int64))
        return (np.concatenate(out), np.concatenate(n)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` each word's ids begin, and how many they are."""
        keys = _words.word_hashes(words)
        if len(self.keys) > REMEMBER:
            self._clear()
        where = np.searchsorted(self.keys, keys)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            flat, n = self._encode([words[i] for i in new.tolist()])
            at = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate((self.flat, flat.astype(self.kind)))
            order = np.argsort(keys[new], kind="stable")
            spot = np.searchsorted(self.keys, keys[new][order])
            self.keys = np.insert(self.keys, spot, keys[new][order])
            self.at = np.insert(self.at, spot, at[order].astype(np.uint32))
            self.n = np.insert(self.n, spot, n[order].astype(np.uint32))
            where = np.searchsorted(self.keys, keys)
        return self.at[where].astype(np.int64), self.n[where].astype(np.int64)


_WORD_IDS: dict[str, WordIds] = {}


def worker_ids(path: str) -> WordIds:
    """The ids that this Python worker remembers from task to task. A function of the
    module, so that tasks share it; what a task's own function refers to is copied."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def token_stream(texts: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """uint32 ids of all texts, END_ID after each, and where each text begins."""
    flat, starts = _words.split(texts)
    codes, words = _words.coded(flat)
    at, n = ids.look_up(words)
    at, n = at[codes], n[codes]
    before = np.concatenate(([0], np.cumsum(n)))  # ids before each word
    begin = before[starts] + np.arange(len(starts))  # an end id after each text
    out = np.full(int(begin[-1]), END_ID, np.uint32)
    place = before[:-1] + _words.owners(starts)
    inside = np.arange(int(before[-1])) - np.repeat(before[:-1], n)
    out[np.repeat(place, n) + inside] = ids.flat[np.repeat(at, n) + inside]
    return out, begin


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(path)
        for rows in _words.slices(batches, "text", 2 << 20):
            stream, begin = token_stream(_words.as_text(rows.column(1)), ids)
            size = np.diff(begin)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            view = memoryview(stream.astype("<u4").tobytes())
            a = (begin[doc] + start) * 4
            crc = [zlib.crc32(view[x:y]) for x, y in zip(a.tolist(), (a + length * 4).tolist(), strict=True)]
            columns = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, length) entries of patterns of one to four documents: for each length, the
    fullest that begin with it and a few other present lengths."""
    present = np.flatnonzero(counts)
    found: set[tuple[int, ...]] = set()

    def fill(head: list[int]) -> None:
        """Close a pattern with the longest present length that still fits."""
        k = int(np.searchsorted(present, capacity - sum(head), "right")) - 1
        found.add(tuple(sorted([*head, int(present[k])] if k >= 0 else head)))

    for a in present.tolist():
        fill([a])
        room = capacity - a
        fit = present[present <= room]
        for q in (0.25, 0.4, 0.55, 0.7, 0.85):
            if len(fit):
                b = int(fit[int(q * (len(fit) - 1))])
                fill([a, b])
        third = present[present <= room // 2]
        for q in (0.5, 0.9):
            if len(third):
                b = int(third[int(q * (len(third) - 1))])
                fill([a, b, b])
    entries = [(p, length) for p, one in enumerate(sorted(found)) for length in one]
    x = np.array(entries, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def nnls(pattern: np.ndarray, length: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns' lengths to
    ``target``: projected gradient steps with momentum on the sparse pattern matrix."""
    n = int(pattern.max()) + 1

    def times(x):
        return np.bincount(length, weights=x[pattern], minlength=len(target))

    def back(r):
        return np.bincount(pattern, weights=r[length], minlength=n)

    v = np.ones(n)
    for _ in range(30):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / max(1e-9, float(np.linalg.norm(back(times(v)))))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _by_patterns(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups of nearly full patterns, taken from ``left``: of each fit the whole parts, then
    once more those patterns whose fractions are largest as long as their pieces last, then
    a fit of what is left, until no pattern is taken. The whole parts alone would leave
    nearly everything where each length has few pieces."""
    groups: list[tuple[int, dict[int, int]]] = []
    for _ in range(FITS):
        if not left.any():
            break
        pattern, length = patterns(left, capacity)
        n = int(pattern.max()) + 1
        total = np.bincount(pattern, weights=length, minlength=n)
        x = np.where(total >= capacity - capacity // 256, nnls(pattern, length, left.astype(float)), 0.0)
        whole = np.floor(x + 1e-9)
        edges = np.searchsorted(pattern, np.arange(n + 1))
        before = len(groups)
        for repeats, order in ((whole, np.argsort(-whole, kind="stable")), (np.ones(n), np.argsort(whole - x, kind="stable"))):
            for p in order.tolist():
                wanted = int(repeats[p]) if x[p] > TAKEN_FROM else 0
                if not wanted:
                    continue
                need: dict[int, int] = {}
                for one in length[edges[p] : edges[p + 1]].tolist():
                    need[one] = need.get(one, 0) + 1
                times = min(wanted, *(int(left[k]) // v for k, v in need.items()))
                if times > 0:
                    groups.append((times, need))
                    for k, v in need.items():
                        left[k] -= times * v
        if len(groups) == before:
            break
    return groups


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups for what is left: longest first, each into the fullest sequence with room."""
    # open sequences by the room they have left
    room: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for one in range(capacity, 0, -1):
        n = int(left[one])
        space = one
        while n:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:
                each = capacity // one
                whole = n // each
                if whole:
                    room[capacity - each * one].append((whole, {one: each}))
                    n -= whole * each
                if n:
                    room[capacity - n * one].append((1, {one: n}))
                n = 0
                break
            have, what = room[space].pop()
            each = min(space // one, max(1, n // have))
            used = min(have, n // each)
            if used < have:
                room[space].append((have - used, what))
            room[space - each * one].append((used, {**what, one: each}))
            n -= used * each
    return [g for spaces in room for g in spaces]


def _repaired(groups: list[tuple[int, dict[int, int]]], left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``groups`` and best-fit groups of what is ``left``. Rounding can leave large pieces
    without small ones to go with: then some patterns, those of most pieces first and never
    half of all, are opened and packed best-fit with the rest, as many as make the fewest
    sequences."""
    by_pieces = sorted(groups, key=lambda g: (-sum(g[1].values()), g[0]))
    total = sum(n for n, _ in groups)
    best: list[tuple[int, dict[int, int]]] | None = None
    for share in OPENED:
        loose, kept, opened = left.copy(), [], 0
        for n, what in by_pieces:
            now = min(n, int(share * total) - opened)
            opened += now
            for k, v in what.items():
                loose[k] += now * v
            if n > now:
                kept.append((n - now, what))
        made = kept + _best_fit(loose, capacity)
        if best is None or sum(n for n, _ in made) < sum(n for n, _ in best):
            best = made
    return best


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: documents}) groups of sequences that use up ``counts`` exactly;
    ``counts[l]`` pieces have length l (1 to ``capacity``). Full pieces are sequences of
    their own; patterns are fitted to the others, and what no pattern takes is packed
    best-fit."""
    left = counts.astype(np.int64).copy()
    full = [(int(left[capacity]), {capacity: 1})] if left[capacity] else []
    left[capacity] = 0
    fitted = _by_patterns(left, capacity)
    return full + _repaired(fitted, left, capacity)


def _slots(groups: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, documents a sequence and offset of each
    group that uses it."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for repeats, what in groups:
        offset = 0
        for length in sorted(what, reverse=True):
            k = what[length]
            out.setdefault(length, []).append((taken.get(length, 0), first, k, offset))
            taken[length] = taken.get(length, 0) + repeats * k
            offset += length * k
        first += repeats
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and then END_ID; only longer ones are cut. A null or empty text is
    the end id alone; rows with a null id and repeated rows are packed like any other; an
    empty table gives an empty one; columns other than the two named are not read.
    """
    # the lot deals rows that agree in everything to different ranks
    rows = staged(pieces_of(docs, id_col, text_col, capacity, tokenizer).withColumn("lot", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    counts[capacity] = 0
    slots = _slots(plan(counts, capacity))
    # full pieces are sequences by themselves, of negative numbers; the others are ranked
    # among those of their length, in parts
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("lot"), "offset": F.lit(0).cast("long")}).drop("lot")
    parts = F.array(*[F.lit(int(-(-n // RANKED)) or 1) for n in counts])
    salted = rows.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("lot"), F.element_at(parts, (F.col("length") + 1).cast("int"))).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "lot")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("place") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = [*np.flatnonzero(np.diff(length[order], prepend=-1)).tolist(), len(order)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = order[a:b]
                start, seq, k, shift = slots[int(length[at[0]])]
                g = np.searchsorted(start, rank[at], "right") - 1
                q = rank[at] - start[g]
                sequence[at] = seq[g] + q // k[g]
                offset[at] = shift[g] + q % k[g] * length[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return wanted.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(full)
