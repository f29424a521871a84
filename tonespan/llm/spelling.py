"""Spelling variants by range searches in k-d trees over letter-count vectors.

Words of one length are points whose coordinates count letters; one inserted, deleted or
replaced letter moves a point by at most two in L1 distance. The top of each length's tree
is cut on a bounded sample; every word is filed under its cell, and asks the cells of its
own length and of the two next to it whose boxes are within reach. In a cell the rest of the
tree is built, questions descend it together and boxes out of reach are pruned; candidates
are verified by the order of their letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._tables import drop, release, staged

#: Fixed values of the query: which runs lose a letter, the shortest word and least count
#: of a word, and how much larger a form's count is.
NOISE, SHORTEST, LEAST, FORM = 199, 6, 5, 5
#: Words of a cell, of a leaf of its tree, and words that the cells are cut on.
CELL, LEAF, SAMPLE = 20_000, 48, 200_000
#: Coordinates: one a letter, those beyond Z share six. Sharing only brings points nearer.
AXES = 32
#: Words counted in memory before they are passed on.
_HELD = 1 << 18

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs_of(texts: pa.Array) -> _words.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. In UTF-8 the latter
    are the byte C3 and the one after it."""
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    latin = raw == 0xC3
    keep = _LETTERS[raw] | latin
    keep[1:] |= latin[:-1]
    spaced = np.where(keep, _LOWER[raw], np.uint8(32)).tobytes()
    return _words.split(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(spaced)], offset=texts.offset))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE) -> DataFrame:
    """(word, n) of the words of all texts, of SHORTEST letters or more. A run loses a letter
    if ``noise`` divides the crc32 of its document's id and itself (none: no run does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for piece in _words.slices(batches, "text"):
            flat, starts = runs_of(_words.as_text(piece.column(1)))
            codes, words = _words.coded(flat)
            long_ = np.fromiter((len(w) >= SHORTEST for w in words), bool, len(words))
            at = long_[codes] if len(words) else np.zeros(0, bool)
            width = max(1, len(words))
            key, times = np.unique(_words.owners(starts)[at] * width + codes[at], return_counts=True)
            doc, code = np.divmod(key, width)
            if noise:
                begin = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in piece.column(0).to_pylist()]
                raw = [w.encode() for w in words]
                h = np.fromiter((zlib.crc32(raw[c], begin[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(key))
                cut = h % noise == 0
                for c, x, n in zip(code[cut].tolist(), h[cut].tolist(), times[cut].tolist(), strict=True):
                    w = words[c]
                    k = x % len(w)
                    if len(w) > SHORTEST:
                        w = w[:k] + w[k + 1 :]
                        held[w] = held.get(w, 0) + n
                code, times = code[~cut], times[~cut]
            total = np.bincount(code, weights=times, minlength=len(words)).astype(np.int64)
            for c in np.flatnonzero(total).tolist():
                held[words[c]] = held.get(words[c], 0) + int(total[c])
            if len(held) >= _HELD:
                yield out()
                held.clear()
        if held:
            yield out()
        _words.trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def points(words: list[str]) -> np.ndarray:
    """Letter-count vectors."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    axis = np.where((code >= 97) & (code < 123), code - 97, 26 + code % (AXES - 26))
    return np.bincount(np.repeat(np.arange(len(words)), size) * AXES + axis, minlength=len(words) * AXES).reshape(len(words), AXES).astype(np.int32)


def _cut(x: np.ndarray) -> tuple[int, int] | None:
    """Axis and bound (at most: left) that divide points most evenly; None if all are equal."""
    best = None
    for axis in np.argsort(-x.var(axis=0), kind="stable")[:6].tolist():
        value, times = np.unique(x[:, axis], return_counts=True)
        if len(value) < 2:
            continue
        left = np.cumsum(times)[:-1]
        k = int(np.argmin(np.abs(2 * left - len(x))))
        uneven = abs(2 * int(left[k]) - len(x))
        if best is None or uneven < best[0]:
            best = uneven, axis, int(value[k])
    return best and best[1:]


class Cells:
    """The top of a length's tree: leaves are cells, numbered from 0."""

    def __init__(self, sample: np.ndarray, most: float):
        """Cut until a cell has ``most`` sampled points or fewer."""
        self.nodes: list[tuple[int, int, int, int]] = []  # axis, bound, left, right; axis -1: cell number
        self.cells = 0
        self._grow(sample, most)

    def _grow(self, x: np.ndarray, most: float) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0, 0, 0))
        cut = _cut(x) if len(x) > most else None
        if cut is None:
            self.nodes[at] = (-1, self.cells, 0, 0)
            self.cells += 1
        else:
            left = x[:, cut[0]] <= cut[1]
            self.nodes[at] = (*cut, self._grow(x[left], most), self._grow(x[~left], most))
        return at

    def within(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell): the cells whose boxes are within ``reach`` of each point. A letter
        moves a point by one at most along any axis, and by ``reach`` in all."""
        found = []
        lowest, highest = np.full(AXES, -(1 << 30)), np.full(AXES, 1 << 30)
        stack = [(0, np.arange(len(x)), lowest, highest)]
        while stack:
            k, own, low, high = stack.pop()
            axis, bound, left, right = self.nodes[k]
            if axis < 0:
                found.append(np.stack((own, np.full(len(own), bound))))
                continue
            for child, lo, hi in ((left, low[axis], bound), (right, bound + 1, high[axis])):
                lo_, hi_ = low.copy(), high.copy()
                lo_[axis], hi_[axis] = lo, hi
                near = own[_box_distance(x[own], lo_, hi_, reach)]
                if len(near):
                    stack.append((child, near, lo_, hi_))
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
    """Whether each point is within ``reach`` of a box, in L1."""
    return (np.maximum(low - x, 0) + np.maximum(x - high, 0)).sum(axis=1) <= reach


def range_search(x: np.ndarray, asked: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``asked``, row of ``x``) with an L1 distance of at most ``reach``: a k-d tree
    over ``x`` that all questions descend together."""
    stack = [(np.arange(len(x)), np.arange(len(asked)))]
    while stack:
        own, who = stack.pop()
        box = x[own]
        who = who[_box_distance(asked[who], box.min(axis=0), box.max(axis=0), reach)]
        if not len(who):
            continue
        cut = _cut(box) if len(own) > LEAF else None
        if cut is not None:
            left = box[:, cut[0]] <= cut[1]
            stack += [(own[left], who), (own[~left], who)]
            continue
        # equal points are one leaf however many, so both sides go in parts
        for a in range(0, len(own), 4 * LEAF):
            part = own[a : a + 4 * LEAF]
            step = max(1, (1 << 18) // len(part))
            for b in range(0, len(who), step):
                some = who[b : b + step]
                apart = np.abs(asked[some].astype(np.int16)[:, None] - x[part].astype(np.int16)[None]).sum(axis=2)
                i, j = np.nonzero(apart <= reach)
                yield some[i], part[j]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words (rows of letters, those of ``b`` as long or one longer) differ by
    exactly one replaced or inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    after = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= a.shape[1]


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1) if words else np.zeros((0, 0), np.uint32)


class Filed(NamedTuple):
    words: list[str]
    n: np.ndarray
    points: np.ndarray
    letters: np.ndarray


def _filed(words: list[str], n: list[int]) -> Filed:
    return Filed(words, np.array(n, np.int64), points(words), _letters(words))


def _answers(cell: Filed, asked: Filed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each asked word the number of near words in the cell, and the one of largest count
    (ties: the first in order); -1: none. Words of a cell come in order."""
    near, best = np.zeros(len(asked.words), np.int64), np.full(len(asked.words), -1, np.int64)
    same, longer = cell.letters.shape[1] == asked.letters.shape[1], asked.letters.shape[1] > cell.letters.shape[1]
    width = max(1, asked.letters.shape[1])
    for i, j in range_search(cell.points, asked.points, 2 if same else 1):
        for a in range(0, len(i), max(1, (1 << 22) // width)):
            who, what = i[a : a + max(1, (1 << 22) // width)], j[a : a + max(1, (1 << 22) // width)]
            one, other = (cell.letters[what], asked.letters[who]) if longer else (asked.letters[who], cell.letters[what])
            hit = one_edit(one, other)
            who, what = who[hit], what[hit]
            if not len(who):
                continue
            np.add.at(near, who, 1)
            # of each asker the largest count, then the first in order
            order = np.lexsort((what, -cell.n[what], who))
            who, first = np.unique(who[order], return_index=True)
            what = what[order][first]
            had = best[who]
            better = (had < 0) | (cell.n[what] > cell.n[np.maximum(had, 0)]) | ((cell.n[what] == cell.n[np.maximum(had, 0)]) & (what < had))
            best[who[better]] = what[better]
    return near, best


_ANSWER = "word string, n long, n_near long, form string, form_n long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of cells, filed words before askers: files are held, askers pass."""
    now, cell, filed = None, None, ([], [])
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("length", "cell", "salt", "asks")), strict=True))
        edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            words, n = part.column("word").to_pylist(), part.column("n").to_pylist()
            if keys[a][:3] != now:
                now, cell, filed = keys[a][:3], None, ([], [])
            if not keys[a][3]:
                filed[0].extend(words)
                filed[1].extend(n)
                cell = None
                continue
            if not filed[0]:
                continue
            if cell is None:
                cell = _filed(*filed)
            asked = _filed(words, n)
            near, best = _answers(cell, asked)
            hit = np.flatnonzero(near)
            if len(hit):
                form = [cell.words[k] for k in best[hit].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in hit.tolist()], pa.string()), pa.array(asked.n[hit]), pa.array(near[hit]), pa.array(form, pa.string()), pa.array(cell.n[best[hit]])], ["word", "n", "n_near", "form", "form_n"])
    _words.trim()


def _tops(words: DataFrame, sample: int, cell: int) -> dict[int, Cells]:
    """The tops of the trees of the lengths that need more than one cell, cut on at most
    about ``sample`` words in all, drawn by a hash."""
    sizes = {r[0]: r[1] for r in words.groupBy("length").count().where(F.col("count") > cell).collect()}
    if not sizes:
        return {}
    share = min(1.0, sample / sum(sizes.values()))
    drawn = words.where(F.col("length").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).select("length", "word").collect()
    by: dict[int, list[str]] = {}
    for r in drawn:
        by.setdefault(r[0], []).append(r[1])
    return {k: Cells(points(by.get(k, [])), max(1.0, cell * len(by.get(k, [])) / n)) for k, n in sizes.items()}


def _filing(words: DataFrame, tops: dict[int, Cells]) -> DataFrame:
    """(length, cell, asks, word, n): each word under its own cell (asks 0), and as an asker of
    every cell of near lengths within reach (asks 1 to 3: words of one length each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                words_ = part.column(0).to_pylist()
                x, size = points(words_), np.fromiter(map(len, words_), np.int64, len(words_))
                for ask, shift in ((False, 0), (True, -1), (True, 0), (True, 1)):
                    at = [np.zeros(0, np.int64)] * 3
                    for length in np.unique(size).tolist():
                        own = np.flatnonzero(size == length)
                        target = length + shift
                        who, cell = tops[target].within(x[own], (1 if shift else 2) if ask else 0) if target in tops else (np.arange(len(own)), np.zeros(len(own), np.int64))
                        at = [np.concatenate(c) for c in zip(at, (own[who], cell, np.full(len(who), target)), strict=True)]
                    take = pa.array(at[0])
                    columns = [pa.array(at[2].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(np.full(len(take), 2 + shift if ask else 0, np.int32)), part.column(0).take(take), part.column(1).take(take)]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length int, cell int, asks int, word string, n long")


def near_words(words: DataFrame, form: int = FORM, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, n, n_near, form, form_n) of distinct ``words`` (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced letter;
    ``form`` is the near word of largest n (ties: the first in order), null if that is less
    than ``form`` times the word's. The sample only decides where the trees are cut; every
    word is filed and asks. A cell of more than ``cell`` words (vectors that no cut parts) is
    dealt out by a hash, and its askers ask every part. No words: no rows.
    """
    words = words.withColumn("length", F.char_length("word").cast("int"))
    tops = _tops(words, sample, cell)
    rows = staged(_filing(words, tops), "spelling-cells")
    sizes = rows.where("asks = 0").groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("size"))
    sized = rows.join(sizes, ["length", "cell"])
    salt = F.when(F.col("asks") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("size")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("size") - 1))
    # rows are small and searches long: as many tasks as cells, whatever their bytes
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(t.cells for t in tops.values()))
    dealt = sized.withColumn("salt", F.explode(salt)).repartition(tasks, "length", "cell", "salt").sortWithinPartitions("length", "cell", "salt", "asks", "word")
    answers = dealt.mapInArrow(_search, _ANSWER)
    by_word = answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best"))
    joined = words.select("word", "n").join(by_word, "word", "left")
    large = -F.col("best.less") >= F.lit(form) * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` and ``root``: the last word that forms lead to. A form's count is several
    times its word's, so paths are short; each round doubles the length that is followed."""
    links = staged(forms.where("form is not null").select("word", F.col("form").alias("to")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        joined = links.join(on, "to", "left")
        moved = staged(joined.select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        drop(links)
        changed = not moved.where("moved").isEmpty()
        links = moved.select("word", "to")
        links.shared_path = moved.shared_path
        if not changed:
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE, least: int = LEAST, form: int = FORM) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least`` or more occurrences.

    Null texts have no words; a null id stands for an empty one in the digest that deletes
    letters; repeated rows count again; an empty table gives an empty one; other columns are
    not read.
    """
    words = staged(word_counts(docs, id_col, text_col, noise).where(F.col("n") >= least), "spelling-words")
    release(docs.sparkSession)
    forms = staged(near_words(words, form), "spelling-forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
