"""Language identification: known words first, shorter and shorter n-grams for the rest.

Every word and every character n-gram (orders 1 to 5, within words and with their ends
marked) of the labelled training texts is counted for each language and kept. Texts are cut
into blocks, which send their distinct words, with their training counts, to buckets of the
range of word hashes. A bucket adds the counts up (the stored table of words, one row a
bucket) and sends the n-grams of its words to buckets of n-gram hashes, which add up as
well (the stored table of n-grams) and answer for the n-grams of words that training has
not seen. A known word adds the log of its frequency in each language; an unknown one is
read from left to right in the longest known n-grams. Each bucket returns to the blocks the
logs of their words, which the blocks sum over their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._packed import bucket_edges, pack, pack_sorted, pack_words, unpack, unpack_sorted, unpack_words
from tonespan.llm._tables import bucketed, drop, drop_shared, release, staged, write_shared

ORDERS = (5, 4, 3, 2, 1)
#: Share of an entry in a language that has never shown it, as a part of one occurrence
#: among all occurrences of its kind in all languages.
FLOOR = 0.5
EDGE = "␂"
UNDEFINED = "und"
BLOCK_WORDS = 1 << 21
#: Words of the corpus for each bucket of words.
BUCKET_WORDS = 1 << 22
#: Buckets of n-grams for each bucket of words.
GRAM_BUCKETS = 1


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower-cased texts in which everything but letters and marks is a space."""
    return pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "))


class Model(NamedTuple):
    """What turns counts into logs: the languages and, for words (kind 0) and n-grams (kind
    their order), the occurrences in each language."""

    languages: list[str]
    totals: np.ndarray  # kinds x languages

    def logs(self, counts: np.ndarray, kind: int) -> np.ndarray:
        """Log frequencies (entries x languages) of counts (languages x entries)."""
        total = self.totals[kind].astype(float)
        floor = FLOOR / max(1.0, total.sum())
        return np.log((counts.T / np.maximum(total, 1) + floor) / (1 + floor))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(first place of each word, number of places, order -> hash at each place) of the
    marked words laid end to end; the last order - 1 places of a word have none (zero)."""
    marked = [f"{EDGE}{w}{EDGE}" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(points))  # places to the end of the word
    found: dict[int, np.ndarray] = {}
    hashes = np.zeros(len(points), np.uint64)
    for order in sorted(ORDERS):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - order + 1] = points[order - 1 :]
        hashes = _words.pair_hash(hashes, shifted)
        found[order] = np.where(left >= order, hashes | np.uint64(1), np.uint64(0))
    return ends - size, size, found


class Known(NamedTuple):
    """Known n-grams of one order: sorted hashes and their logs."""

    keys: np.ndarray
    logs: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.keys, hashes).clip(max=len(self.keys) - 1)
        return np.where((hashes != 0) & (self.keys[at] == hashes), at, -1)


def read_unknown(words: list[str], known: dict[int, Known], wide: int) -> np.ndarray:
    """Summed logs (words x languages) of the longest known n-grams from left to right; a
    place where none begins is passed over."""
    first, size, hashes = grams_of(words)
    rows = {order: known[order].rows(hashes[order]) for order in ORDERS}
    out = np.zeros((len(words), wide))
    at, end = first.copy(), first + size
    open_ = np.flatnonzero(at < end)
    while len(open_):
        step = np.ones(len(open_), np.int64)
        left = np.arange(len(open_))
        for order in ORDERS:
            row = rows[order][at[open_[left]]]
            hit = left[row >= 0]
            out[open_[hit]] += known[order].logs[row[row >= 0]]
            step[hit] = order
            left = left[row < 0]
            if not len(left):
                break
        at[open_] += step
        open_ = open_[at[open_] < end[open_]]
    return out


_BLOCKS = "block long, ids array<long>, sizes array<long>, codes binary, times binary, words binary, langs array<string>, trained_keys binary, trained_n binary, totals array<struct<lang:string,kind:int,n:long>>"


def _blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column) -> DataFrame:
    """Blocks of texts: for each text its distinct words and how often they stand in it; for
    the block its words in the order of their hashes and their training counts."""
    label = F.when(F.coalesce(train, F.lit(False)) & F.col(text_col).isNotNull(), F.col(lang_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), label.alias("lang"), F.col(text_col).cast("string").alias("text"))
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.struct([("lang", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])))
    names = ["block", "ids", "sizes", "codes", "times", "words", "langs", "trained_keys", "trained_n", "totals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        langs: list = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            texts = [w for *_, own in held for w in own]
            hashes, first, place = np.unique(_words.word_hashes(texts), return_index=True, return_inverse=True)
            words = [texts[i] for i in first.tolist()]
            shift = np.cumsum([0, *(len(own) for *_, own in held)])[:-1]
            before = np.cumsum([0, *(len(size) for size, *_ in held)])[:-1]
            doc = np.concatenate([np.repeat(np.arange(len(size)), size) + b for (size, *_), b in zip(held, before, strict=True)])
            code = np.concatenate([place[codes + s] for (_, codes, _, _), s in zip(held, shift, strict=True)])
            times = np.concatenate([n for _, _, n, _ in held])
            order = np.lexsort((code, doc))
            code, times = code[order], times[order]
            known = sorted({x for x in langs if x is not None})
            of_doc = np.array([known.index(x) if x is not None else -1 for x in langs], np.int64)
            of_pair = of_doc[doc]
            some = of_pair >= 0
            keys, inverse = np.unique(of_pair[some] * max(1, len(words)) + code[some], return_inverse=True)
            n = np.bincount(inverse, weights=times[some], minlength=len(keys)).astype(np.int64)
            size = pc.utf8_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 2
            lang, word = keys // max(1, len(words)), keys % max(1, len(words))
            totals = []
            for kind in (0, *ORDERS):
                each = n if kind == 0 else n * np.maximum(size[word] - kind + 1, 0)
                totals += [{"lang": known[k], "kind": kind, "n": int(x)} for k, x in enumerate(np.bincount(lang, weights=each, minlength=len(known)).tolist())]
            sizes = np.concatenate([size for size, *_ in held])
            row = (uuid.uuid4().int >> 65, ids, sizes, pack(np.diff(code.astype(np.uint32), prepend=np.uint32(0))), pack(times.astype(np.uint32)), pack_words(words), known, pack_sorted(keys.astype(np.uint64)), pack(n.astype(np.uint64)), totals)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for piece in _words.slices(batches, "text"):
            flat, starts = _words.split(letters_only(_words.as_text(piece.column(2))))
            codes, words = _words.coded(flat)
            lettered = pc.match_substring_regex(pa.array(words, pa.string()), r"\pL").to_numpy(zero_copy_only=False)
            pairs, n = np.unique(_words.owners(starts) * max(1, len(words)) + codes, return_counts=True)
            doc, code = pairs // max(1, len(words)), pairs % max(1, len(words))
            if len(words) and not lettered.all():  # a word of marks alone is none
                stays = lettered[code]
                doc, code, n = doc[stays], code[stays], n[stays]
                place = np.cumsum(lettered) - 1
                code, words = place[code], [w for w, keep in zip(words, lettered.tolist(), strict=True) if keep]
            held.append((np.bincount(doc, minlength=piece.num_rows), code, n, words))
            ids.extend(piece.column(0).to_pylist())
            langs.extend(piece.column(1).to_pylist())
            tokens += len(codes)
            if tokens >= BLOCK_WORDS:
                yield flush()
                ids, langs, held, tokens = [], [], [], 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, _BLOCKS)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, fields)])


_WORD_REQUEST = [("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]


def _word_requests(blocks: DataFrame, languages: list[str], buckets: int) -> DataFrame:
    """The words of each block for each bucket, with counts (languages x words)."""
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = unpack_words(r["words"])
                hashes = _words.word_hashes(words)
                keys, n = unpack_sorted(r["trained_keys"]).astype(np.int64), unpack(r["trained_n"]).astype(np.int64)
                lang = np.array([place[x] for x in r["langs"]], np.int64)[keys // max(1, len(words))] if len(keys) else keys
                word = keys % max(1, len(words))
                by_word = np.argsort(word, kind="stable")
                lang, word, n = lang[by_word], word[by_word], n[by_word]
                edges = bucket_edges(hashes, buckets)
                cuts = np.searchsorted(word, edges)
                rows = []
                for b, (x, y, i, j) in enumerate(zip(edges, edges[1:], cuts, cuts[1:], strict=False)):
                    if x < y:
                        counts = np.zeros((len(languages), y - x), np.uint64)
                        counts[lang[i:j], word[i:j] - x] = n[i:j]
                        rows.append((b, r["block"], pack_words(words[x:y]), pack(counts.ravel())))
                yield _batch(rows, _WORD_REQUEST)
            _words.trim()

    return blocks.select("block", "words", "langs", "trained_keys", "trained_n").mapInArrow(run, "bucket int, block long, words binary, counts binary")


_CELL = [("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.binary())]


def _cell(request: pa.Table, wide: int) -> pa.Table:
    """One bucket: its distinct words, their counts, and which of them each block has."""
    lists = [unpack_words(x.as_py()) for x in request["words"]]
    encoded = pa.array([w for own in lists for w in own], pa.string()).dictionary_encode()
    code, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
    counts = np.zeros((wide, len(words)))
    at = 0
    for own, data in zip(lists, request["counts"], strict=True):
        part = code[at : at + len(own)]
        counts[:, part] += unpack(data.as_py()).reshape(wide, len(own))  # a block has a word once
        at += len(own)
    row = (request["bucket"][0].as_py(), pack_words(words), pack(counts.astype(np.uint64).ravel()), request["block"].to_pylist(), list(map(len, lists)), pack(code.astype(np.uint32)))
    _words.trim()
    return _table([row], _CELL)


_GRAM_REQUEST = [("gram_bucket", pa.int32()), ("order", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("wanted", pa.binary())]


def _gram_requests(cells: DataFrame, wide: int, buckets: int) -> DataFrame:
    """For each bucket of words and order: the n-grams of trained words with their counts,
    and those that unknown words ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = unpack_words(r["words"])
                if not words:
                    continue
                counts = unpack(r["counts"]).reshape(wide, len(words)).astype(float)
                trained = counts.any(axis=0)
                _, size, hashes = grams_of(words)
                owner = np.repeat(np.arange(len(words)), size)
                for order in ORDERS:
                    there = np.flatnonzero(hashes[order])
                    keys, inverse = np.unique(hashes[order][there], return_inverse=True)
                    word = owner[there]
                    own = np.stack([np.bincount(inverse, weights=counts[k, word], minlength=len(keys)) for k in range(wide)]) if wide else np.zeros((0, len(keys)))
                    wanted = np.zeros(len(keys), bool)
                    wanted[inverse[~trained[word]]] = True
                    edges = bucket_edges(keys, buckets)
                    rows = [(b, order, r["bucket"], pack_sorted(keys[x:y]), pack(own[:, x:y].astype(np.uint64).ravel()), np.packbits(wanted[x:y]).tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
                    yield _batch(rows, _GRAM_REQUEST)
            _words.trim()

    return cells.select("bucket", "words", "counts").mapInArrow(run, "gram_bucket int, order int, bucket int, keys binary, counts binary, wanted binary")


_GRAM_REPLY = [("kind", pa.string()), ("order", pa.int32()), ("gram_bucket", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]


def _gram_totals(request: pa.Table, wide: int) -> pa.Table:
    """Totals of a bucket of n-grams: the stored table and an answer to each bucket of words."""
    order, own = request["order"][0].as_py(), request["gram_bucket"][0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in request["keys"]]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros((wide, len(distinct)))
    cuts = np.cumsum([0, *map(len, keys)])
    for k, data in enumerate(request["counts"]):
        part = inverse[cuts[k] : cuts[k + 1]]
        total[:, part] += unpack(data.as_py()).reshape(wide, len(part))
    some = total.any(axis=0)
    rows = [("grams", order, own, None, pack_sorted(distinct[some]), pack(total[:, some].astype(np.uint64).ravel()))]
    for k, (bucket, wanted) in enumerate(zip(request["bucket"].to_pylist(), request["wanted"], strict=True)):
        part = inverse[cuts[k] : cuts[k + 1]]
        asked = np.unpackbits(np.frombuffer(wanted.as_py(), np.uint8), count=len(part)).astype(bool)
        part = part[asked & some[part]]
        if len(part):
            rows.append(("reply", order, own, bucket, pack_sorted(distinct[part]), pack(total[:, part].astype(np.uint64).ravel())))
    _words.trim()
    return _table(rows, _GRAM_REPLY)


_LOGS = [("block", pa.int64()), ("bucket", pa.int32()), ("logs", pa.binary())]


def _word_logs(cells: DataFrame, replies: DataFrame, model: Model) -> DataFrame:
    """(block, bucket, logs): of each block's words of a bucket, in the block's order."""
    wide = len(model.languages)
    gathered = replies.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("order", "gram_bucket", "keys", "counts"))).alias("grams"))
    joined = cells.join(gathered, "bucket", "left").select("bucket", "words", "counts", "blocks", "sizes", "places", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = unpack_words(r["words"])
                counts = unpack(r["counts"]).reshape(wide, len(words)).astype(float)
                logs = model.logs(counts, 0)
                unknown = np.flatnonzero(~counts.any(axis=0))
                if len(unknown):
                    known = {}
                    for order in ORDERS:
                        own = [x for x in r["grams"] or [] if x["order"] == order]
                        keys = np.concatenate([unpack_sorted(x["keys"]) for x in own]) if own else np.zeros(0, np.uint64)
                        some = np.concatenate([unpack(x["counts"]).reshape(wide, -1) for x in own], axis=1) if own else np.zeros((wide, 0))
                        known[order] = Known(keys, model.logs(some.astype(float), order))
                    logs[unknown] = read_unknown([words[i] for i in unknown.tolist()], known, wide)
                places = unpack(r["places"], np.uint32).astype(np.int64)
                cuts = np.cumsum([0, *r["sizes"]])
                yield _batch([(block, r["bucket"], pack(logs[places[x:y]].astype(np.float32).ravel())) for block, x, y in zip(r["blocks"], cuts, cuts[1:], strict=False)], _LOGS)
            _words.trim()

    return joined.mapInArrow(run, "block long, bucket int, logs binary")


def _summed(blocks: DataFrame, logs: DataFrame, languages: list[str]) -> DataFrame:
    """(id, lang_pred, score) of every text of the blocks."""
    wide = len(languages)
    gathered = logs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "logs"))).alias("logs"))
    joined = blocks.select("block", "ids", "sizes", "codes", "times").join(gathered, "block", "left").select("ids", "sizes", "codes", "times", "logs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = batch.column(0)[k].values, np.array(batch.column(1)[k].as_py(), np.int64)
                code = np.cumsum(unpack(batch.column(2)[k].as_py(), np.uint32), dtype=np.uint32).astype(np.int64)
                times = unpack(batch.column(3)[k].as_py(), np.uint32).astype(np.float64)
                found = batch.column(4)[k].as_py() or []
                starts = np.concatenate(([0], np.cumsum(sizes)))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = np.bincount(doc, weights=times, minlength=len(sizes))
                if wide and found:
                    own = np.concatenate([unpack(x["logs"], np.float32) for x in found]).reshape(-1, wide)
                    total = np.zeros((len(sizes), wide))
                    for c in range(wide):
                        # sums of each text by itself: ties stay ties whatever the block
                        filled = np.flatnonzero(sizes)
                        if len(filled):
                            total[filled, c] = np.add.reduceat(own[code, c].astype(np.float64) * times, starts[:-1][filled])
                    best = total.argmax(axis=1)
                    share = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(n, 1)[:, None])
                    score = np.where(n > 0, share[np.arange(len(n)), best] / share.sum(axis=1), 0.0)
                    names = [languages[b] if m else UNDEFINED for b, m in zip(best.tolist(), n.tolist(), strict=True)]
                else:
                    names, score = [UNDEFINED] * len(n), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
            _words.trim()

    return joined.mapInArrow(run, "id long, lang_pred string, score double")


class Tables(NamedTuple):
    """Paths of the stored model: words and n-grams (``kind=grams``) with their counts, each
    row one bucket of the range of hashes."""

    words: str
    grams: str


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, Tables]:
    """(id, lang_pred, score) of every row of ``docs``, and where the model is stored.

    ``train`` says which rows to learn from (null: not); rows with a null label or text
    teach nothing. ``lang_pred`` is the language of the largest sum of word logs (ties: the
    first in alphabetical order), ``und`` if the text is null or has no letter or no
    language was learned; ``score`` is its share of the summed likelihoods, each the
    geometric mean of a word's (0 for ``und``). Only the text is read for that. Rows with a
    null id and repeated rows are predicted like any other; an empty table gives an empty
    one; further columns are not read. Labels are few: their totals come to the driver.
    """
    spark = docs.sparkSession
    blocks = bucketed(_blocks(docs, id_col, text_col, lang_col, train), "language_blocks", "block")
    totals = blocks.select(F.explode("totals").alias("t")).groupBy("t.lang", "t.kind").agg(F.sum("t.n").alias("n")).where("n > 0 or kind = 0").collect()
    languages = sorted({r["lang"] for r in totals if r["kind"] == 0 and r["n"]})
    wide = len(languages)
    model = Model(languages, np.zeros((max(ORDERS) + 1, wide), np.int64))
    for r in totals:
        if r["lang"] in languages:
            model.totals[r["kind"], languages.index(r["lang"])] = r["n"]
    words = blocks.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    buckets = max(1, int(words) // BUCKET_WORDS)
    cells = staged(_word_requests(blocks, languages, buckets).groupBy("bucket").applyInArrow(lambda t: _cell(t, wide), "bucket int, words binary, counts binary, blocks array<long>, sizes array<long>, places binary"), "language-words")
    release(spark)
    grams = write_shared(_gram_requests(cells, wide, buckets * GRAM_BUCKETS).groupBy("gram_bucket", "order").applyInArrow(lambda t: _gram_totals(t, wide), "kind string, order int, gram_bucket int, bucket int, keys binary, counts binary"), "language-grams", ["kind"])
    release(spark)
    replies = spark.read.schema("kind string, order int, gram_bucket int, bucket int, keys binary, counts binary").parquet(grams).where("kind = 'reply'")
    logs = staged(_word_logs(cells, replies, model), "language-logs")
    drop_shared(spark, f"{grams}/kind=reply")
    release(spark)
    found = staged(_summed(blocks, logs, languages), "language-predictions")
    drop(logs, blocks)
    return found, Tables(cells.shared_path, grams)
