"""Katz backoff language model with exact Good-Turing discounts and backoff weights.

Texts are cut into blocks of about BLOCK_TOKENS tokens, kept as codes of a local
vocabulary. Each block sends its distinct n-grams, as sorted 64-bit hashes with their
training counts, to buckets of the hash range; a bucket adds up the counts, stores them
(the count tables, partitioned by order) and answers every block with the totals. One
block that has a training occurrence of an n-gram is named its owner, so that sums over
the distinct n-grams of a context can be formed from the blocks without a second copy of
the tables. From the totals and the count-of-counts a block knows the discounted
probability of every n-gram it has; owners send, for each context, the mass that discounts
free and the lower-order probability of the words seen. Their sums give the backoff weight
(the second stored table), with which probabilities over the vocabulary and the unknown
word add up to one exactly. Tokens are evaluated recursively: the n-gram if training has
it, else the context's weight times the probability in the shorter context.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._packed import bucket_edges, pack, pack_sorted, pack_values, unpack, unpack_sorted, unpack_values
from tonespan.llm._tables import bucketed, drop, drop_shared, release, shared_dir

ORDER = 3
#: Counts up to this one are discounted.
GOOD_TURING = 5
#: What larger counts lose, in occurrences.
LARGE = 0.5
BLOCK_TOKENS = 3 << 18
#: Tokens of the corpus for each bucket of n-gram hashes, and of contexts.
BUCKET_TOKENS = 1 << 20
CONTEXT_TOKENS = 1 << 21
#: Parts of the range of contexts that are exchanged, and of the blocks that are evaluated,
#: one after another: what a part needed goes before the next, so that on disk lie the
#: exchange of one part and what others wait for, not twice the whole.
PARTS, BLOCK_PARTS = 16, 8

# names with a space cannot be words
END = _words.word_hashes([" end"])[0]
BEGIN = _words.word_hashes([" begin"])[0]


class Grams(NamedTuple):
    """Distinct n-grams of a block, in the order of their hashes."""

    hashes: np.ndarray
    of_token: np.ndarray  # n-gram that ends at each token; -1: none
    context: np.ndarray  # of each n-gram: the (n-1)-gram before its last word
    suffix: np.ndarray  # of each n-gram: the (n-1)-gram without its first word
    trained: np.ndarray  # training occurrences in the block


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and which each key is. Which of several
    places does not matter here, so the sort need not be stable."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _ordered(hashes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(hashes)  # distinct ones
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, hashes[order], *(c[order] for c in columns)


def block_grams(vocabulary: np.ndarray, codes: np.ndarray, starts: np.ndarray, train: np.ndarray, order: int) -> list[Grams]:
    """Grams of orders 1 to ``order``. ``vocabulary`` is sorted; BEGIN stands before the
    first token of a text and is a context only (number len(vocabulary) of order 1)."""
    trained = np.repeat(train, np.diff(starts))
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    none = np.zeros(0, np.int64)
    out = [Grams(vocabulary, codes, none, none, np.bincount(codes[trained], minlength=len(vocabulary)))]
    for n in range(2, order + 1):
        lower = out[-1]
        at = np.flatnonzero(place >= n - 2)
        if n == 2:
            context = np.where(place[at] > 0, codes[at - 1], len(vocabulary))
            context_hash = np.append(vocabulary, BEGIN)
        else:
            context, context_hash = lower.of_token[at - 1], lower.hashes
        pairs, first, inverse = _distinct(context * len(vocabulary) + codes[at])
        context, word = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
        hashes = _words.pair_hash(context_hash[context], vocabulary[word])
        counts = np.bincount(inverse[trained[at]], minlength=len(pairs))
        rank, hashes, context, suffix, counts = _ordered(hashes, context, lower.of_token[at[first]], counts)
        of_token = np.full(len(codes), -1, np.int64)
        of_token[at] = rank[inverse]
        out.append(Grams(hashes, of_token, context, suffix, counts))
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    names = ["block", "doc_ids", "train", "n_tokens", "tokens", "vocabulary", "codes"]
    kinds = "block long, doc_ids array<long>, train array<boolean>, n_tokens array<long>, tokens long, vocabulary binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        flags: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            vocabulary, codes = np.unique(tokens, return_inverse=True)
            row = [
                [uuid.uuid4().int >> 65],
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([flags], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                [len(tokens)],
                [pack_sorted(vocabulary)],
                [pack(codes.astype(np.uint32))],
            ]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in row], names)

        for piece in _words.slices(batches, "text"):
            flat, starts = _words.split(_words.as_text(piece.column(2)), lower=True)
            codes, words = _words.coded(flat)
            hashes = _words.word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
            held.append(np.insert(hashes, starts[1:], END))
            sizes.append(np.diff(starts) + 1)
            ids.extend(piece.column(0).to_pylist())
            flags.extend(piece.column(1).to_pylist())
            if sum(map(len, held)) >= BLOCK_TOKENS:
                yield flush()
                ids, flags, sizes, held = [], [], [], []
        if held:
            yield flush()

    return rows.mapInArrow(run, kinds)


def _decoded(batch: pa.RecordBatch, k: int, order: int) -> tuple[np.ndarray, list[Grams], np.ndarray, np.ndarray]:
    """Bounds of the texts, grams, document ids' positions and training flags of a block."""
    get = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
    sizes = np.array(get["n_tokens"].as_py(), np.int64)
    train = np.array(get["train"].as_py(), bool)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    grams = block_grams(unpack_sorted(get["vocabulary"].as_py()), unpack(get["codes"].as_py(), np.uint32).astype(np.int64), starts, train, order)
    return starts, grams, sizes, train


def _count_requests(blocks: DataFrame, level: int, buckets: int) -> DataFrame:
    """The distinct n-grams of an order of each block for each bucket."""
    names = ["level", "bucket", "block", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                own = _decoded(batch, k, level)[1][-1]
                edges = bucket_edges(own.hashes, buckets)
                rows = [(level, b, block, pack_sorted(own.hashes[x:y]), pack(own.trained[x:y].astype(np.uint32))) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)
                del own, rows
                _words.trim()

    return blocks.mapInArrow(run, "level int, bucket int, block long, keys binary, counts binary")


_REPLY = "kind string, level int, bucket int, block long, keys binary, counts binary, of_counts array<long>"


def _add_up(request: pa.Table) -> pa.Table:
    """Totals of one bucket: a stored table, an answer to each block, count-of-counts."""
    level, bucket = request["level"][0].as_py(), request["bucket"][0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in request["keys"]]
    counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in request["counts"]]).astype(np.int64)
    distinct, _, inverse = _distinct(np.concatenate(keys))
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
    trained = np.flatnonzero(counts)
    owner = np.zeros(len(counts), bool)
    first = np.empty(len(distinct), np.int64)
    first[inverse[trained[::-1]]] = trained[::-1]  # the first is written last
    owner[first[np.unique(inverse[trained])]] = True
    some = total > 0
    of_counts = np.bincount(np.minimum(total[some], GOOD_TURING + 2).astype(np.int64), minlength=GOOD_TURING + 3)
    summary = np.append(of_counts, total.sum()).astype(np.int64)
    rows = [("counts", level, bucket, None, pack_sorted(distinct[some]), pack(total[some]), None), ("summary", level, bucket, None, None, None, summary.tolist())]
    at = 0
    for block, own in zip(request["block"].to_pylist(), keys, strict=True):
        part = slice(at, at + len(own))
        rows.append(("reply", level, bucket, block, np.packbits(owner[part]).tobytes(), pack(total[inverse[part]]), None))
        at += len(own)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "level", "bucket", "block", "keys", "counts", "of_counts"])


class Discounts(NamedTuple):
    """Of one order: factors of the counts from 0 on. A larger count r is kept up to
    (r - LARGE) / r, so that no context is left without mass for unseen words."""

    factor: np.ndarray
    total: int  # training occurrences
    types: int
    unknown: float  # share of the unknown word (order 1)

    def of(self, counts: np.ndarray) -> np.ndarray:
        large = 1 - LARGE / np.maximum(counts, 1)
        return np.where(counts < len(self.factor), self.factor[np.minimum(counts, len(self.factor) - 1)], large)


def discounts(of_counts: np.ndarray, total: int) -> Discounts:
    """Katz's discounts from the count-of-counts, for as many counts (at most GOOD_TURING)
    as give factors between 0 and 1; if not even count 1 does, one absolute discount
    n1 / (n1 + 2 n2), or half an occurrence where that is not between 0 and 1."""
    n = of_counts.astype(float)
    factor = None
    for k in range(GOOD_TURING, 0, -1):
        if not all(n[1 : k + 2] > 0):
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - rest) / (1 - rest)
        if np.all((found > 0) & (found < 1)):
            factor = np.concatenate(([0.0], found))
            break
    if factor is None:
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        r = np.arange(1, GOOD_TURING + 1)
        factor = np.concatenate(([0.0], (r - off) / r))
    r = np.arange(len(factor))
    freed = float(((1 - factor) * r * n[: len(r)]).sum() + LARGE * n[len(r) :].sum())
    return Discounts(factor, total, int(n.sum()), freed / total if total else 1.0)


class Totals(NamedTuple):
    total: np.ndarray
    owner: np.ndarray


def _probabilities(grams: list[Grams], totals: list[Totals], params: list[Discounts], texts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the probability of each n-gram that training has (else 0) and the
    training occurrences of its context."""
    first = params[0]
    seen = [first.of(totals[0].total) * totals[0].total / max(1, first.total)]
    before = [np.zeros(0, np.int64)]
    for n in range(2, len(grams) + 1):
        lower = np.append(totals[0].total, texts) if n == 2 else totals[n - 2].total
        context = lower[grams[n - 1].context]
        own = totals[n - 1].total
        before.append(context)
        seen.append(params[n - 1].of(own) * own / np.maximum(context, 1))
    return seen, before


_PARTIAL = "kind string, part int, level int, bucket int, block long, doc int, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, keys binary, x binary, y binary, z binary, over binary"


def _evaluate(blocks: DataFrame, replies: DataFrame, params: list[Discounts], texts: int, buckets: int) -> DataFrame:
    """What each block knows: of its documents ("doc"), of the contexts of n-grams that it
    owns ("context"), and which backoff weights its documents need ("need")."""
    order = len(params)
    gathered = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("level", "bucket", "keys", "counts"))).alias("replies"))
    joined = blocks.join(gathered, "block").select("block", "doc_ids", "train", "n_tokens", "tokens", "vocabulary", "codes", "replies")
    fields = [f.strip().split() for f in _PARTIAL.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}

    def rows_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from evaluate(batch, k)
                _words.trim()

    def evaluate(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        block = batch.column(0)[k].as_py()
        starts, grams, sizes, train = _decoded(batch, k, order)
        parts: list[list[Totals]] = [[] for _ in range(order)]
        for reply in batch.column(7)[k].as_py():
            total = unpack(reply["counts"]).astype(np.int64)
            parts[reply["level"] - 1].append(Totals(total, np.unpackbits(np.frombuffer(reply["keys"], np.uint8), count=len(total)).astype(bool)))
        none = Totals(np.zeros(0, np.int64), np.zeros(0, bool))
        totals = [Totals(*(np.concatenate(c) for c in zip(*p, strict=True))) if p else none for p in parts]
        seen, before = _probabilities(grams, totals, params, texts)
        first = params[0]
        owner = np.repeat(np.arange(len(sizes)), sizes)

        def by_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=len(sizes))

        c1 = totals[0].total[grams[0].of_token]
        base = by_doc(np.log10((c1 + 0.1) / (first.total + 0.1 * (first.types + 1))))
        known = by_doc(c1 > 0)
        log = np.zeros(len(owner))
        open_ = np.ones(len(owner), bool)
        for n in range(order, 1, -1):
            at = np.flatnonzero(open_ & (grams[n - 1].of_token >= 0))
            own = grams[n - 1].of_token[at]
            p = seen[n - 1][own]
            hit = p > 0
            log[at[hit]] = np.log10(p[hit])
            open_[at[hit]] = False
            # the context is known and the word after it is not: its weight is needed
            lack = ~hit & (before[n - 1][own] > 0)
            if lack.any():
                context_hash = np.append(grams[0].hashes, BEGIN) if n == 2 else grams[n - 2].hashes
                pair, times = np.unique(grams[n - 1].context[own[lack]] * len(sizes) + owner[at[lack]], return_counts=True)
                hashes, doc = context_hash[pair // len(sizes)], pair % len(sizes)
                by_hash = np.argsort(hashes, kind="stable")
                hashes, doc, times = hashes[by_hash], doc[by_hash], times[by_hash]
                edges = bucket_edges(hashes, buckets)
                yield rows_of(
                    [
                        {"kind": "need", "part": b % PARTS, "level": n, "bucket": b, "block": block, "keys": pack_sorted(hashes[x:y]), "x": pack(doc[x:y].astype(np.uint32)), "y": pack(times[x:y].astype(np.uint32))}
                        for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False))
                        if x < y
                    ]
                )
            # what the owned n-grams say of their contexts
            mine = np.flatnonzero(totals[n - 1].owner)
            if len(mine):
                context = grams[n - 1].context[mine]
                count = totals[n - 1].total[mine]
                # in occurrences, not shares: these are few different values, which pack well
                freed = (1 - params[n - 1].of(count)) * count
                suffix = grams[n - 1].suffix[mine]
                below = totals[n - 2].total[suffix]
                covered = params[n - 2].of(below) * below
                over = np.full(len(mine), first.total) if n == 2 else before[n - 2][suffix]
                which, first_of, inverse = _distinct(context)
                context_hash = np.append(grams[0].hashes, BEGIN) if n == 2 else grams[n - 2].hashes
                _, hashes, freed, covered, times, over = _ordered(
                    context_hash[which], np.bincount(inverse, weights=freed), np.bincount(inverse, weights=covered), before[n - 1][mine][first_of], over[first_of]
                )
                edges = bucket_edges(hashes, buckets)
                yield rows_of(
                    [
                        {"kind": "context", "part": b % PARTS, "level": n, "bucket": b, "block": block, "keys": pack_sorted(hashes[x:y])} | {name: pack_values(v[x:y]) for name, v in (("x", freed), ("y", covered), ("z", times), ("over", over))}
                        for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False))
                        if x < y
                    ]
                )
        at = np.flatnonzero(open_)
        p = seen[0][grams[0].of_token[at]]
        log[at] = np.log10(np.where(p > 0, p, first.unknown))
        score = by_doc(log)
        ids = batch.column(1)[k].as_py()
        yield rows_of(
            [
                {"kind": "doc", "part": 0, "block": block, "doc": d, "doc_id": i, "train": bool(t), "n_tokens": int(n), "n_known": int(w), "base_score": float(b), "score": float(s)}
                for d, (i, t, n, w, b, s) in enumerate(zip(ids, train, sizes, known, base, score, strict=True))
            ]
        )

    return joined.mapInArrow(run, _PARTIAL)


def _weights(rows: pa.Table) -> pa.Table:
    """Backoff weights of one bucket of contexts, and what they add to each document."""
    kinds = np.array(rows["kind"].to_pylist())
    level, bucket = rows["level"][0].as_py(), rows["bucket"][0].as_py()
    out = []
    at = np.flatnonzero(kinds == "context").tolist()
    keys = np.concatenate([unpack_sorted(rows["keys"][i].as_py()) for i in at]) if at else np.zeros(0, np.uint64)
    distinct, _, inverse = _distinct(keys)

    def values(column: str) -> np.ndarray:
        return np.concatenate([unpack_values(rows[column][i].as_py()) for i in at]) if at else np.zeros(0)

    freed, covered = (np.bincount(inverse, weights=values(c), minlength=len(distinct)) for c in ("x", "y"))
    times, over = np.zeros(len(distinct)), np.ones(len(distinct))
    times[inverse], over[inverse] = values("z"), values("over")
    log_weight = np.log10(freed / times / np.maximum(1 - covered / over, 1e-12))
    out.append(("weights", level, bucket, None, None, None, pack_sorted(distinct), pack_values(log_weight)))
    for i in np.flatnonzero(kinds == "need").tolist():
        own = unpack_sorted(rows["keys"][i].as_py())
        which, place = np.unique(unpack(rows["x"][i].as_py(), np.uint32), return_inverse=True)
        add = np.bincount(place, weights=log_weight[np.searchsorted(distinct, own)] * unpack(rows["y"][i].as_py(), np.uint32))
        out.append(("add", level, bucket, rows["block"][i].as_py(), which.astype(np.uint32).tobytes(), add.tobytes(), None, None))
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "level", "bucket", "block", "docs", "adds", "keys", "log_weight"])


_WEIGHTS = "kind string, level int, bucket int, block long, docs binary, adds binary, keys binary, log_weight binary"


def _added(rows: pa.Table) -> pa.Table:
    """(block, doc, add): what backoff weights add to the documents of one block."""
    rows = rows.sort_by([("level", "ascending"), ("bucket", "ascending")])
    doc = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows["docs"]])
    which, place = np.unique(doc, return_inverse=True)
    add = np.bincount(place, weights=np.concatenate([np.frombuffer(x.as_py()) for x in rows["adds"]]))
    return pa.table({"block": pa.array([rows["block"][0].as_py()] * len(which), pa.int64()), "doc": pa.array(which.astype(np.int32)), "add": pa.array(add)})


class Tables(NamedTuple):
    """Paths of the stored model: counts partitioned by kind and order (``kind=counts``)
    and backoff weights (``kind=weights``), each row one bucket of the hash range."""

    counts: str
    weights: str


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, Tables]:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row, and
    where the model is stored.

    ``train`` says which rows to learn from (null: not). A null text is empty: its end is
    its only token. Rows with a null id and repeated rows are scored, and learned from,
    like any other; without training rows every token is the unknown word, whose
    probability is then one; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    part_of = F.pmod(F.xxhash64("block"), F.lit(BLOCK_PARTS)).cast("int")
    blocks = bucketed(_blocks(docs, id_col, text_col, train).withColumn("part", part_of), "katz_blocks", "block", "part")
    sizes = blocks.select(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    tokens, texts = int(sizes[0]), int(sizes[1])
    # order by order, the largest exchange while least else is stored
    counts_path = f"{shared_dir(spark)}/katz-counts-{uuid.uuid4().hex}"
    for level in range(order, 0, -1):
        answers = _count_requests(blocks.drop("part"), level, max(1, tokens // BUCKET_TOKENS)).groupBy("level", "bucket").applyInArrow(_add_up, _REPLY)
        answers.withColumn("part", F.coalesce(part_of, F.lit(0))).write.mode("append").partitionBy("kind", "part", "level").parquet(counts_path)
        del answers
        release(spark)

    stored = spark.read.schema(f"{_REPLY}, part int").parquet(counts_path)
    summed = {n: np.zeros(GOOD_TURING + 4, np.int64) for n in range(1, order + 1)}
    listed = stored.where("kind = 'summary'").select("level", F.posexplode("of_counts").alias("r", "n"))
    for level, r, n in listed.groupBy("level", "r").agg(F.sum("n")).collect():
        summed[level][r] = n
    params = [discounts(summed[n][:-1], int(summed[n][-1])) for n in range(1, order + 1)]
    del stored, listed

    partial_path = f"{shared_dir(spark)}/katz-partial-{uuid.uuid4().hex}"
    location = blocks.location
    present = sorted(r[0] for r in blocks.select("part").distinct().collect()) or [0]
    for k in present:
        mine = spark.table(blocks.table_name).where(F.col("part") == k).drop("part")
        replies = spark.read.schema(f"{_REPLY}, part int").parquet(counts_path).where((F.col("kind") == "reply") & (F.col("part") == k)).select("level", "bucket", "block", "keys", "counts")
        _evaluate(mine, replies, params, texts, max(1, tokens // CONTEXT_TOKENS)).write.mode("append").partitionBy("kind", "part").parquet(partial_path)
        # nothing reads these blocks and answers again
        del mine, replies
        drop_shared(spark, f"{location}/part={k}")
        drop_shared(spark, f"{counts_path}/kind=reply/part={k}")
        release(spark)
    drop(blocks)
    del blocks
    weights_path = f"{shared_dir(spark)}/katz-weights-{uuid.uuid4().hex}"
    for part in range(min(PARTS, max(1, tokens // CONTEXT_TOKENS))):  # the others have no bucket
        exchanged = spark.read.schema(_PARTIAL).parquet(partial_path).where(f"kind in ('context', 'need') and part = {part}").select("kind", "level", "bucket", "block", "keys", "x", "y", "z", "over")
        exchanged.groupBy("level", "bucket").applyInArrow(_weights, _WEIGHTS).write.mode("append").partitionBy("kind").parquet(weights_path)
        del exchanged
        for kind in ("context", "need"):
            drop_shared(spark, f"{partial_path}/kind={kind}/part={part}")
        release(spark)
    partial = spark.read.schema(_PARTIAL).parquet(partial_path)
    added = spark.read.schema(_WEIGHTS).parquet(weights_path).where("kind = 'add'").select("level", "bucket", "block", "docs", "adds").groupBy("block").applyInArrow(_added, "block long, doc int, add double")
    rows = partial.where("kind = 'doc'").join(added, ["block", "doc"], "left")
    scores = rows.select("doc_id", "train", "n_tokens", "n_known", F.lit(params[0].total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score"))
    return scores, Tables(counts_path, weights_path)
