"""How far the sources of a language differ in their words, by single-pass in-memory indexing.

Tasks build the postings of a block (term, group of language and source, occurrences and
documents) in memory until it fills, then spill a run sorted by term, cut into hash shards
of the terms. Runs of a shard are heap-merged, first within lanes (about the square root of
the tasks), then lane by lane, into the stored frequencies of the kept terms. Smoothed
integer shares of two sources differ from those of an unseen term only for terms that one of
them has: a pair's sum begins as if neither had any term, histograms of a source's own
shares correct it for terms that one side has, and the postings are streamed once to correct
it for terms that both have.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonespan.llm import _words
from tonespan.llm._packed import pack, pack_words, unpack, unpack_words
from tonespan.llm._tables import release, staged

#: Documents of a language that must have a term for it to be kept.
LEAST_DOCS = 3
#: Terms that are listed of a group.
TOP = 200
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Postings that a block holds in memory before it is spilled.
RUN_POSTINGS = 1 << 21
#: Pairs of postings, and pairs of groups with a sum, that a task holds at once.
_PAIRS, _HELD = 1 << 19, 1 << 21

#: ASCII other than letters parts terms; every other byte belongs to one.
_TERM_BYTES = bytes(32 if b < 128 and not re.match(rb"[A-Za-z]", bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(texts: pa.Array) -> _words.Words:
    """Lower-cased terms: runs of ASCII letters and of anything beyond ASCII."""
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    spaced = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERM_BYTES))], offset=texts.offset)
    return _words.split(spaced)


class Run(NamedTuple):
    """Postings in the order of (term, group)."""

    terms: list[str]  # in order
    groups: list[tuple[str, str]]  # (language, source)
    term: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray


def _summed(term: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """One posting for each (term, group), in order."""
    key = term << np.int64(32) | group
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return term, group, count, docs
    return key[first] >> np.int64(32), key[first] & np.int64(0xFFFFFFFF), np.add.reduceat(count[order], first), np.add.reduceat(docs[order], first)


class Block:
    """Postings of a block of texts, in memory."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, texts: pa.Array, groups: list[tuple[str, str]]) -> None:
        flat, starts = terms_of(texts)
        codes, words = _words.coded(flat)
        term_of = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in words), np.int64, len(words))
        group_of = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        in_doc, count = np.unique(_words.owners(starts) * max(1, len(words)) + codes, return_counts=True)
        doc, code = np.divmod(in_doc, max(1, len(words)))
        found = _summed(term_of[code], group_of[doc], count.astype(np.int64), np.ones(len(code), np.int64))
        self.held.append(found)
        self.size += len(found[0])

    def full(self, limit: int) -> bool:
        """Whether the block, with its postings summed, fills half of ``limit`` or more."""
        if self.size < limit:
            return False
        self.held = [_summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])
        return 2 * self.size >= limit

    def run(self) -> Run:
        names = list(self.terms)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        term, group, count, docs = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else [np.zeros(0, np.int64)] * 4
        return Run([names[k] for k in order], list(self.groups), *_summed(rank[term], group, count, docs))


def heap_merged(runs: list[Run]) -> Run:
    """One run of several: their sorted terms meet in a heap, equal postings add up."""
    groups: dict[tuple[str, str], int] = {}
    group_of = [np.fromiter((groups.setdefault(g, len(groups)) for g in r.groups), np.int64, len(r.groups)) for r in runs]
    terms: list[str] = []
    place: list[list[int]] = [[] for _ in runs]
    for term, k in heapq.merge(*(zip(r.terms, itertools.repeat(k)) for k, r in enumerate(runs))):
        if not terms or terms[-1] != term:
            terms.append(term)
        place[k].append(len(terms) - 1)
    term = np.concatenate([np.array(p, np.int64)[r.term] for p, r in zip(place, runs, strict=True)])
    group = np.concatenate([g[r.group] for g, r in zip(group_of, runs, strict=True)])
    return Run(terms, list(groups), *_summed(term, group, np.concatenate([r.count for r in runs]), np.concatenate([r.docs for r in runs])))


_PIECE = "shard int, lane int, terms binary, groups string, term binary, postings binary, counts binary, docs binary"
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _row(shard: int, lane: int, run: Run) -> tuple:
    return (shard, lane, pack_words(run.terms), json.dumps(run.groups), pack(np.diff(run.term, prepend=0).astype(np.uint32)), pack(run.group.astype(np.uint32)), pack(run.count), pack(run.docs))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _read(table: pa.Table) -> Iterator[Run]:
    for r in table.to_pylist():
        groups = [tuple(g) for g in json.loads(r["groups"])]
        yield Run(unpack_words(r["terms"]), groups, np.cumsum(unpack(r["term"], np.uint32).astype(np.int64)), unpack(r["postings"], np.uint32).astype(np.int64), unpack(r["counts"], np.int64), unpack(r["docs"], np.int64))


def _spilled(run: Run, shards: int, lane: int) -> pa.RecordBatch | None:
    """The run cut into shards of its terms."""
    shard = np.fromiter((xxhash.xxh64_intdigest(t) % shards for t in run.terms), np.int64, len(run.terms))
    of_posting = shard[run.term]
    order = np.argsort(of_posting, kind="stable")
    edges = np.searchsorted(of_posting[order], np.arange(shards + 1))
    rows = []
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        if a < b:
            own = order[a:b]
            used, term = np.unique(run.term[own], return_inverse=True)
            rows.append(_row(k, lane, Run([run.terms[t] for t in used.tolist()], run.groups, term, run.group[own], run.count[own], run.docs[own])))
    return _rows(rows) if rows else None


def runs(docs: DataFrame, text_col: str, lang_col: str, source_col: str, shards: int, lanes: int, limit: int | None = None) -> DataFrame:
    """Term-sorted runs of blocks, a row for each shard."""
    limit = limit or RUN_POSTINGS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % lanes
        block = Block()
        for piece in _words.slices(batches, "text"):
            block.add(_words.as_text(piece.column(0)), list(zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)))
            if block.full(limit):
                if (out := _spilled(block.run(), shards, lane)) is not None:
                    yield out
                block = Block()
                _words.trim()
        if block.size and (out := _spilled(block.run(), shards, lane)) is not None:
            yield out
        _words.trim()

    empty = F.lit("")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"))
    return rows.mapInArrow(index, _PIECE)


_FREQUENCIES = "lang string, term string, total long, sources array<string>, counts array<long>"


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, sources, counts) of the terms that ``least`` or more documents of a
    language have. ``docs`` is read once; null text, language and source are empty strings."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = math.ceil(math.sqrt(docs.select(text_col).rdd.getNumPartitions() or 1))

    def lane(table: pa.Table) -> pa.Table:
        one = heap_merged(list(_read(table)))
        return pa.Table.from_batches([_rows([_row(table["shard"][0].as_py(), -1, one)])])

    def shard(table: pa.Table) -> pa.Table:
        one = heap_merged(list(_read(table)))
        langs = list(dict.fromkeys(lang for lang, _ in one.groups))
        lang = np.array([langs.index(x) for x, _ in one.groups], np.int64)[one.group]
        order = np.lexsort((one.term, lang))
        key = (lang * max(1, len(one.terms)) + one.term)[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        kept = np.add.reduceat(one.docs[order], first) >= least
        size = np.diff(np.append(first, len(order)))
        total = np.add.reduceat(one.count[order], first)[kept]
        order, first, size = order[np.repeat(kept, size)], first[kept], size[kept]
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        which = key[first] // max(1, len(one.terms)), key[first] % max(1, len(one.terms))
        source = pa.array([s for _, s in one.groups], pa.string()).take(pa.array(one.group[order]))
        columns = [pa.array(langs, pa.string()).take(pa.array(which[0])), pa.array(one.terms, pa.string()).take(pa.array(which[1])), pa.array(total), pa.ListArray.from_arrays(offsets, source), pa.ListArray.from_arrays(offsets, pa.array(one.count[order]))]
        _words.trim()
        return pa.Table.from_arrays(columns, names=["lang", "term", "total", "sources", "counts"])

    pieces = runs(docs, text_col, lang_col, source_col, shards, lanes)
    return pieces.groupBy("shard", "lane").applyInArrow(lane, _PIECE).groupBy("shard").applyInArrow(shard, _FREQUENCIES)


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), in whole numbers."""
    return F.lit(1) + F.call_function("div", _whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), F.greatest(_whole(n + v), F.lit(1).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are small enough for 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that both sources have add to the sums that
    count them as if one or neither had them. ``postings``: lang, sources, p, p0 lists."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            names = list(codes)
            left, right = keys >> np.int64(32), keys & np.int64(0xFFFFFFFF)
            columns = [pa.array([names[k][0] for k in left.tolist()], pa.string()), pa.array([names[k][1] for k in left.tolist()], pa.string()), pa.array([names[k][1] for k in right.tolist()], pa.string()), pa.array(sums)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = batch.column(1).flatten()
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            lang = pa.array(np.repeat(np.arange(batch.num_rows), size))
            langs, sources = batch.column(0).take(lang).to_pylist(), entries.field(0).to_pylist()
            code = np.fromiter((codes.setdefault(g, len(codes)) for g in zip(langs, sources, strict=True)), np.int64, len(sources))
            p, p0 = entries.field(1).to_numpy(zero_copy_only=False), entries.field(2).to_numpy(zero_copy_only=False)
            begin = np.repeat(np.cumsum(size) - size, size)
            many = np.repeat(size, size)
            part = np.cumsum(many) // _PAIRS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(many)]
            for a, b in zip(edges, edges[1:], strict=False):
                n = many[a:b]
                left = np.repeat(np.arange(a, b), n)
                right = np.repeat(begin[a:b], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                left, right = left[left != right], right[left != right]
                add = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
                keys, inverse = np.unique(np.concatenate((keys, code[left] << np.int64(32) | code[right])), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, inverse, np.concatenate((sums, add)))
                sums = total
                if len(keys) >= _HELD:
                    yield out()
                    keys, sums = keys[:0], sums[:0]
        if len(keys):
            yield out()
        _words.trim()

    return postings.mapInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring group of language and
    source: part ``pair`` has every other source of the language, part ``term`` the terms
    that the group has more often than its language, up to rank ``top``.

    Null text, language and source are empty strings; repeated rows count like any other
    document; a language without kept terms has pairs of value 0 and no terms; an empty
    table gives an empty one; equal values are ranked by the bytes of the item; other columns
    are not read. All arithmetic is in whole numbers.
    """
    found = staged(frequencies(docs, text_col, lang_col, source_col, least), "frequencies")
    release(docs.sparkSession)
    empty, zero = F.lit(""), F.lit(0).cast("long")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    each = found.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("at")).select("lang", "term", "total", F.col("at.sources").alias("source"), F.col("at.counts").alias("count"))
    kept = found.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    size = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    stats = groups.join(size, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "n_lang")])
    stats = staged(stats.withColumn("p0", share(zero, F.col("n"), F.col("v"))), "groups")
    shares = each.join(stats, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    # sources in pairs: as if neither had a term, then terms of one side, then of both
    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = stats.join(other, "lang").where("source != item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    base = pairs.select("lang", "source", "item", (_whole(F.col("v")) * apart(p0, q0)).alias("value"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    one = pairs.join(histogram, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(_whole(F.col("times")) * (apart(p, q0) - apart(p0, q0))).alias("left"), F.sum(_whole(F.col("times")) * (apart(q0, p) - apart(q0, p0))).alias("right"))
    both = _corrections(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).select("lang", "entries"))
    parts = [base, one.select("lang", "source", "item", F.col("left").alias("value")), one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("right").alias("value")), both]
    summed = None
    for part in parts:
        part = part.withColumn("value", F.col("value").cast("decimal(38,0)"))
        summed = part if summed is None else summed.unionByName(part)
    order = [F.col("value").desc(), F.col("item")]
    by_group = Window.partitionBy("lang", "source").orderBy(*order)
    pair = summed.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(by_group)).withColumn("part", F.lit("pair"))

    # terms: the first of every salt hold the first of all
    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    terms = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    salt = F.pmod(F.xxhash64("item"), F.lit(64))
    some = terms.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("place") <= top)
    term = some.select("lang", "source", "item", "value", F.row_number().over(by_group).alias("rank")).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))


def oracle() -> str:
    """DuckDB SQL of ``divergence`` over ``documents``."""
    f = "CAST((({p} - {q}) * ({p} - {q})) // {q} AS BIGINT)"
    part = "1 + (({scale}::HUGEINT * ({c} + 1)) // ({n} + {v}))"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
ls AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
gs AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(gs.n, 0) AS n, coalesce(ls.v, 0) AS v, coalesce(ls.n, 0) AS nl FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN gs USING (lang, source) LEFT JOIN ls ON x.lang = ls.lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, {part.format(scale=SCALE, c="coalesce(c.c, 0)", n="g.n", v="g.v")} AS p, {part.format(scale=SCALE, c="kept.total", n="g.nl", v="g.v")} AS q FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum({f.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ap AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(pr.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
tm AS (SELECT lang, source, term AS item, {f.format(p="p", q="q")} AS value FROM p WHERE c > 0 AND p > q),
rk AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM ap
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM tm)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM rk WHERE part = 'pair' OR rank <= {TOP}"""
