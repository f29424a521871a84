"""Removal of repeated passages.

Paragraphs (lines; those shorter than a shingle join such neighbours) get MinHash
signatures of their word shingles, cut into bands; paragraphs that share a band are
compared by exact Jaccard similarity, and links form components. A passage that repeats
inside longer paragraphs is no paragraph, so banding alone cannot see it: besides, windows
of MIN_WORDS words at winnowed anchors are linked when equal. Anchors depend on the words near them alone, and
every run of PASSAGE words holds a whole window. In every class, one occurrence stays (the
smallest document, then the first place); the others are cut. A window grows to both sides
as far as the words equal those around the occurrence that stays, REACH words at most: if
more are equal, the next window of the run begins within them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespan.llm import _words
from tonespan.llm._graph import bucket_edges, connected_components
from tonespan.llm._tables import drop, free_name, release, staged
from tonespan.llm.simhash import key_of

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
#: Repeated runs of this many words are certain to be found.
PASSAGE = 50
#: Words to each side of a window that are compared; a run as long begins another window.
REACH = PASSAGE - MIN_WORDS
#: Bands and rows a band: similarity 0.8 shares a band with probability 0.995.
BANDS, ROWS = 10, 4
#: Shingles from which a paragraph can be similar to one with other shingles: with fewer,
#: one shingle more or less is already below the similarity.
BANDED = 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)
    made = _words.mix(k * np.uint64(0x9E3779B97F4A7C15))
    return made[::2] | np.uint64(1), made[1::2]


class Units(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    words: np.ndarray
    content: np.ndarray
    bands: pa.ListArray | None = None
    shingles: pa.ListArray | None = None


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def anchors(grams: np.ndarray, starts: np.ndarray, words: int = MIN_WORDS, passage: int = PASSAGE) -> np.ndarray:
    """Places from which a window of ``words`` words is taken: the least shingle hash of
    every run of (passage - words) places that can begin a window, or of all such places
    where a text has fewer; of equal hashes the last. ``grams``: shingle hash of each place
    (any value where none begins); ``starts``: where each text begins."""
    n = len(grams)
    places = np.maximum(np.diff(starts) - words + 1, 0)
    bits = max(1, int(n).bit_length())
    # the place in the low bits makes the least unique, later places first
    keyed = (grams >> np.uint64(bits) << np.uint64(bits)) | (np.uint64((1 << bits) - 1) - np.arange(n, dtype=np.uint64))
    width = passage - words
    found = []
    long_ = np.flatnonzero(places >= width)
    if len(long_):
        least = _sliding_least(keyed, width)
        size = places[long_] - width + 1
        first = np.repeat(starts[long_], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found.append(least[first])
    short = np.flatnonzero((places > 0) & (places < width))
    if len(short):
        edges = np.stack([starts[short], starts[short] + places[short]], axis=1).ravel()
        padded = np.append(keyed, np.uint64(0xFFFFFFFFFFFFFFFF))
        found.append(np.minimum.reduceat(padded, edges)[::2])
    if not found:
        return np.zeros(0, np.int64)
    low = np.unique(np.concatenate(found)) & np.uint64((1 << bits) - 1)
    return np.sort((1 << bits) - 1 - low.astype(np.int64))


def _runs_as_two(doc: np.ndarray, at: np.ndarray, content: np.ndarray, starts: np.ndarray) -> Units:
    """Windows as units. Where equal windows of a text overlap (a word or phrase over and
    over), the first is one unit and all others together are a second, with its content."""
    same = np.zeros(len(at), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (content[1:] == content[:-1]) & (np.diff(at) <= MIN_WORDS)
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(at)) - 1
    rest = np.flatnonzero(last > first)
    second = first[rest] + 1
    rows = np.concatenate((first, second))
    size = np.concatenate((np.full(len(first), MIN_WORDS), at[last[rest]] + MIN_WORDS - at[second])) if len(at) else np.zeros(0, np.int64)
    return Units(doc[rows], at[rows] - starts[doc[rows]], size, content[rows])


def _joined_lines(size: np.ndarray, doc: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of each paragraph: a line of ``words`` words, or as many shorter
    lines that follow each other in a text as have them together."""
    first: list[int] = []
    count: list[int] = []
    begin, have, own = 0, 0, -1  # of the shorter lines that wait for more
    for i, (n, d) in enumerate(zip(size.tolist(), doc.tolist(), strict=True)):
        if n >= words or d != own:
            have = 0
        own = d
        if not n:
            continue
        if not have:
            begin = i
        have += n
        if have >= words:
            first.append(begin)
            count.append(i + 1 - begin)
            have = 0
    return np.array(first, np.int64), np.array(count, np.int64)


def units_of(texts: pa.Array) -> tuple[Units, Units]:
    """Windows and paragraphs of some texts."""
    split = pc.split_pattern(pc.ascii_lower(texts), "\n")
    per_text = split.offsets.to_numpy().astype(np.int64)
    lines = split.flatten()
    flat, line_starts = _words.split(pa.concat_arrays([lines, lines.slice(0, 0)]))
    starts = line_starts[per_text - per_text[0]]
    codes, vocabulary = _words.coded(flat)
    hashes = _words.word_hashes(vocabulary)[codes] if vocabulary else np.zeros(0, np.uint64)
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        grams[: n - SHINGLE + 1] = _words.gram_hashes(hashes, SHINGLE)

    at = anchors(grams, starts)
    content = hashes[at]
    for k in range(1, MIN_WORDS):
        content = _words.pair_hash(content, hashes[at + k])
    windows = _runs_as_two(np.searchsorted(starts, at, "right") - 1, at, content, starts)

    of_line = np.repeat(np.arange(len(texts)), np.diff(per_text))
    line, lines = _joined_lines(np.diff(line_starts), of_line)
    begin, doc = line_starts[line], of_line[line]
    size = line_starts[line + lines] - begin
    if not len(line):
        none = np.zeros(0, np.int64)
        return windows, Units(none, none, none, np.zeros(0, np.uint64))
    word_at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    inside = word_at - np.repeat(begin, size)
    content = np.add.reduceat(_words.pair_hash(hashes[word_at], inside.astype(np.uint64)), np.cumsum(size) - size)
    count = size - SHINGLE + 1
    first = np.cumsum(count) - count
    own = grams[np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(first, count)]
    factor, add = hash_parameters()
    banded = count >= BANDED
    of_gram = np.repeat(banded, count)
    own, size_of = own[of_gram], count[banded]
    first = np.cumsum(size_of) - size_of
    bands = np.zeros((len(size_of), BANDS), np.uint64)
    for b in range(BANDS if len(size_of) else 0):
        key = np.full(len(size_of), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = _words.pair_hash(key, np.minimum.reduceat(own * factor[k] + add[k], first))
        bands[:, b] = key
    short = (own >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def lists(each: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), pa.array(values))

    listed = lists(np.where(banded, BANDS, 0), bands.view(np.int64).ravel()), lists(np.where(banded, count, 0), short)
    return windows, Units(doc, begin - starts[doc], size, content, *listed)


_UNITS = "kind string, doc_id long, doc_key long, start int, words int, content long, bands array<long>, shingles array<int>"


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    names = [f.split()[0] for f in _UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "text"):
            for kind, found in zip(("window", "paragraph"), units_of(_words.as_text(piece.column(2))), strict=True):
                n = len(found.doc)
                if not n:
                    continue
                take = pa.array(found.doc)
                if found.bands is None:
                    bands, shingles = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))
                else:
                    bands, shingles = found.bands, found.shingles
                columns = [pa.array([kind] * n), piece.column(0).take(take), piece.column(1).take(take), pa.array(found.start, pa.int32()), pa.array(found.words, pa.int32()), pa.array(found.content.view(np.int64)), bands, shingles]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, _UNITS)


def jaccard_link(similarity: float):
    """Exact Jaccard similarity of the ``shingles`` of two rows."""

    def link(table: pa.Table):
        sets = [frozenset(x) for x in table.column("shingles").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate([np.fromiter(s, np.int64, len(s)) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)

        def test(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            if len(left) < 64:
                both = np.fromiter((len(sets[a] & sets[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.int64, len(left))
            else:
                both = np.zeros(len(left), np.int64)
                # rows that stand near each other are compared: a dense block at a time
                for a in range(int(left.min()), int(left.max()) + 1, 256):
                    pairs = np.flatnonzero((left >= a) & (left < a + 256))
                    if not len(pairs):
                        continue
                    stop = int(right[pairs].max()) + 1
                    if len(pairs) * 16 < (min(a + 256, stop) - a) * (stop - a):
                        both[pairs] = [len(sets[x] & sets[y]) for x, y in zip(left[pairs].tolist(), right[pairs].tolist(), strict=True)]
                        continue
                    inside = slice(*np.searchsorted(row, [a, stop]))
                    which, column = np.unique(flat[inside], return_inverse=True)
                    held = np.zeros((stop - a, len(which)), np.float32)
                    held[row[inside] - a, column] = 1
                    common = held[: min(256, stop - a)] @ held.T
                    both[pairs] = np.rint(common[left[pairs] - a, right[pairs] - a]).astype(np.int64)
            return both >= similarity * (size[left] + size[right] - both) - 1e-9

        return test

    return link


def _paragraph_classes(paragraphs: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the paragraphs that are similar to another one."""
    index = paragraphs.select(F.explode("bands").alias("key"), F.col("content").alias("node"))
    release(paragraphs.sparkSession)
    # a band that two different contents share
    shared = index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("key")
    shared = staged(shared, "shared-bands")
    candidates = staged(index.join(shared, "key").distinct(), "bands")
    release(paragraphs.sparkSession)
    wanted = candidates.select(F.col("node").alias("content")).distinct()
    # merged at every size: which contents are wanted grows with the corpus
    shingles = paragraphs.join(wanted.hint("merge"), "content", "left_semi").select(F.col("content").alias("node"), "shingles").dropDuplicates(["node"])
    found = connected_components(bucket_edges(candidates.join(shingles, "node"), jaccard_link(similarity), block=128))
    drop(candidates, shared)
    release(paragraphs.sparkSession)
    return found


def contexts_of(texts: pa.Array, doc: np.ndarray, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, n_left, right, n_right) of spans of texts: 32-bit hashes of the REACH words
    before each, nearest first, and after it, and how many of them there are."""
    flat, starts = _words.split(texts, lower=True)
    codes, vocabulary = _words.coded(flat)
    hashes = (_words.word_hashes(vocabulary)[codes] >> np.uint64(32)).astype(np.uint32) if vocabulary else np.zeros(0, np.uint32)
    padded = np.concatenate((np.zeros(REACH, np.uint32), hashes, np.zeros(REACH, np.uint32)))
    begin = starts[doc] + start
    end = begin + words
    step = np.arange(REACH)
    left = padded[(begin + REACH - 1)[:, None] - step]
    right = padded[(end + REACH)[:, None] + step]
    return left, np.minimum(start, REACH), right, np.minimum(starts[doc + 1] - end, REACH)


_WINDOWS = "doc_id long, doc_key long, content long, start int, words int, left binary, n_left int, right binary, n_right int"


def _with_contexts(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The windows (doc_key, content, start, words) and the words around them."""
    places = windows.distinct().groupBy("doc_key").agg(F.collect_list(F.struct("content", "start", "words")).alias("places"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    names = [f.split()[0] for f in _WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "text"):
            lists = piece.column(3)
            found = lists.flatten()
            doc = np.repeat(np.arange(piece.num_rows), pc.list_value_length(lists).to_numpy().astype(np.int64))
            content, start, words = found.field(0), *(found.field(k).to_numpy().astype(np.int64) for k in (1, 2))
            left, n_left, right, n_right = contexts_of(_words.as_text(piece.column(2)), doc, start, words)
            take = pa.array(doc)
            columns = [piece.column(0).take(take), piece.column(1).take(take), content, start, words, list(map(bytes, left)), n_left, list(map(bytes, right)), n_right]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # merged at every size: the places grow with the corpus
    return rows.join(places.hint("merge"), "doc_key").select("doc_id", "doc_key", "text", "places").mapInArrow(run, _WINDOWS).dropDuplicates(["doc_key", "start"])


def _equal_words(mine: pa.Array, n_mine: pa.Array, kept: pa.Array, n_kept: pa.Array) -> np.ndarray:
    """How many leading hashes agree."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, REACH) for x in (mine, kept))
    same = np.logical_and.accumulate(a == b, axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(n_mine.to_numpy(), n_kept.to_numpy()))


def _grown(windows: DataFrame, kept: DataFrame) -> DataFrame:
    """Spans of the windows (with contexts) that are not the one their class keeps, grown
    as far as their words equal those around that one."""
    # one row for each class: the context of the occurrence that stays
    classes = kept.where("kind = 'window'").select(F.col("cluster").alias("content"), F.col("first.doc_key").alias("doc_key"), F.col("first.start").alias("start"))
    around = windows.join(classes, ["content", "doc_key", "start"]).select("content", F.col("doc_id").alias("kept_doc_id"), F.col("doc_key").alias("kept_key"), F.col("start").alias("kept_start"), F.col("words").alias("kept_words"), F.col("left").alias("kept_left"), F.col("n_left").alias("kept_n_left"), F.col("right").alias("kept_right"), F.col("n_right").alias("kept_n_right"))
    pairs = windows.join(around, "content").where((F.col("doc_key") != F.col("kept_key")) | (F.col("start") != F.col("kept_start")))
    names = ["doc_id", "doc_key", "first_word", "n_words", "kept_doc_id", "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = dict(zip(batch.schema.names, batch.columns, strict=True))
            start, words, kept_start, kept_words = (row[c].to_numpy().astype(np.int64) for c in ("start", "words", "kept_start", "kept_words"))
            before = _equal_words(row["left"], row["n_left"], row["kept_left"], row["kept_n_left"])
            after = _equal_words(row["right"], row["n_right"], row["kept_right"], row["kept_n_right"])
            # in one document the occurrence that stays is not cut into
            own = row["doc_key"].to_numpy() == row["kept_key"].to_numpy()
            before = np.where(own, np.minimum(before, np.maximum(start - kept_start - kept_words, 0)), before)
            yield pa.RecordBatch.from_arrays([row["doc_id"], row["doc_key"], pa.array(start - before, pa.int32()), pa.array(words + before + after, pa.int32()), row["kept_doc_id"], row["content"]], names)

    return pairs.mapInArrow(run, "doc_id long, doc_key long, first_word int, n_words int, kept_doc_id long, cluster long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, doc_key, first_word, n_words, kept_doc_id, cluster): every occurrence that
    is not the one its class keeps; ``kept_doc_id`` holds that one. Windows are grown to the
    whole run of words that equal those around the one that stays.

    Words are compared lower-cased (A-Z); white space does not count. Null and empty texts
    and those of fewer words than a shingle have no units. Rows that agree in id and text are one document; a null id counts
    as the largest. An empty table gives an empty one; other columns are not read.
    """
    units = staged(_units(docs, id_col, text_col), "units")
    near = _paragraph_classes(units.where("kind = 'paragraph'"), similarity)
    # of most units there is one: only the others move with their places
    several = units.groupBy("kind", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "content")
    wanted = staged(several.unionByName(near.select(F.lit("paragraph").alias("kind"), F.col("node").alias("content"))).distinct(), "repeated-contents")
    rows = staged(units.select("kind", "doc_id", "doc_key", "start", "words", "content").join(wanted.hint("merge"), ["kind", "content"], "left_semi"), "repeated-units")
    drop(units, wanted)
    release(docs.sparkSession)
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "doc_key", "start")
    mapped = near.select(F.lit("paragraph").alias("kind"), F.col("node").alias("content"), "component")
    classed = rows.join(mapped, ["kind", "content"], "left").withColumn("cluster", F.coalesce("component", "content")).withColumn("place", order)
    kept = staged(classed.groupBy("kind", "cluster").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last"), "kept-places")
    found = classed.where("kind = 'paragraph'").join(kept, ["kind", "cluster"]).where("place != first").dropDuplicates(["kind", "doc_key", "start"])
    kept_id = F.when(F.col("first.id") < F.lit((1 << 63) - 1), F.col("first.id"))
    spans = found.select("doc_id", "doc_key", F.col("start").alias("first_word"), F.col("words").alias("n_words"), kept_id.alias("kept_doc_id"), "cluster")
    several_places = kept.where("kind = 'window'").select(F.col("cluster").alias("content"))
    chosen = rows.where("kind = 'window'").join(several_places.hint("merge"), "content", "left_semi").select("doc_key", "content", "start", "words")
    windows = staged(_with_contexts(docs, chosen, id_col, text_col), "windows")
    release(docs.sparkSession)
    spans = spans.unionByName(_grown(windows, kept))
    out = staged(spans, "repeats")
    drop(rows, near, kept, windows)
    return out


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, doc_key, spans): the spans of a document, those that meet as one."""
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("n_units", pa.int32()), ("kept_doc_id", pa.int64())]))

    def merge(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            start, end, kept = r["first_word"], r["first_word"] + r["n_words"], r["kept_doc_id"]
            if out and start <= out[-1]["first_word"] + out[-1]["n_words"]:
                last = out[-1]
                last["n_words"] = max(last["n_words"], end - last["first_word"])
                last["n_units"] += 1
                if kept is not None and (last["kept_doc_id"] is None or kept < last["kept_doc_id"]):
                    last["kept_doc_id"] = kept
            else:
                out.append({"first_word": start, "n_words": r["n_words"], "n_units": 1, "kept_doc_id": kept})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([merge(x) for x in batch.column(2).to_pylist()], kind)], ["doc_id", "doc_key", "spans"])

    grouped = spans.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words", "kept_doc_id"))).alias("units"))
    return grouped.mapInArrow(run, "doc_id long, doc_key long, spans array<struct<first_word:int,n_words:int,n_units:int,kept_doc_id:long>>")


def cut_words(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space after them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        first, stop = s["first_word"], s["first_word"] + s["n_words"]
        out.append(text[at : places[first][0]])
        at = places[stop][0] if stop < len(places) else len(text)
    out.append(text[at:])
    return "".join(out)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with repeated passages cut from the texts; ``count_col``, if
    ``docs`` has it, is set to the length of a text that was cut. A document of which
    nothing is left goes; untouched ones stay as they are."""
    repeats = repeated_spans(docs, id_col, text_col, similarity)
    spans = staged(merged_spans(repeats), "spans")
    drop(repeats)
    release(docs.sparkSession)
    own, cuts = free_name(docs, "_key"), free_name(docs, "_spans")
    spans = spans.select(F.col("doc_key").alias(own), F.col("spans").alias(cuts)).dropDuplicates([own])
    keyed = docs.withColumn(own, key_of(id_col, text_col))
    columns = docs.columns
    # merged at every size: the spans grow with the corpus
    rows = keyed.join(spans.hint("merge"), own, "left").select(*columns, cuts)
    schema = T.StructType([*docs.schema.fields])
    at = columns.index(text_col)
    counted = columns.index(count_col) if count_col in columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns))
            touched = pc.is_valid(spans).to_numpy(zero_copy_only=False)
            rows = list(batch.columns[:-1])
            if touched.any():
                texts, cuts = rows[at].to_pylist(), spans.to_pylist()
                keep = np.ones(len(texts), bool)
                for i in np.flatnonzero(touched).tolist():
                    texts[i] = cut_words(texts[i], cuts[i])
                    keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
                rows[at] = pa.array(texts, rows[at].type)
                if counted >= 0:
                    size = pc.cast(pc.utf8_length(rows[at]), rows[counted].type)
                    rows[counted] = pc.if_else(pa.array(touched), size, rows[counted])
                rows = [c.filter(pa.array(keep)) for c in rows]
            yield pa.RecordBatch.from_arrays(rows, columns)
        _words.trim()

    return rows.mapInArrow(run, schema)
