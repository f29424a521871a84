"""Source divergence, document fingerprints and spelling variants: brute force and odd rows."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tonespan.llm import divergence, fingerprints, spelling

UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 11: source divergence


def diverging(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) of rows of (text, lang, source)."""
    count, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((own[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("postings, top", [(1 << 21, 200), (300, 7)])
def test_divergence_equals_sums_over_all_terms(spark, odd_docs, monkeypatch, postings, top):
    monkeypatch.setattr(divergence, "RUN_POSTINGS", postings)
    rng = random.Random(5)
    rows = [(" ".join(f"Wört{rng.choice('abcdeé漢')}{rng.choice('xyzß')}{'q' * rng.randrange(3)}" for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None, "é", "z\n"])) for _ in range(120)]
    rows += [(None, None, None), ("", "lone", "s"), ("", "lone", "t"), ("12 34", "empty", "s")] + [rows[0]] * 4
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = [tuple(r) for r in divergence.divergence(docs, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == diverging(rows, top=top)
    assert {r[4] for r in got if r[0] in ("lone", "empty")} == {0}


def test_divergence_of_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    got = [tuple(r) for r in divergence.divergence(odd_docs).collect()]
    assert set(got) == diverging(rows) and len(got) == len(set(got))
    assert divergence.divergence(no_docs).count() == 0


def test_divergence_equals_its_sql(spark, documents, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = [tuple(r) for r in divergence.divergence(documents).collect()]
    assert sorted(got) == sorted(con.sql(divergence.oracle()).fetchall())


def test_heap_merge_of_runs():
    rng = random.Random(3)
    runs, want = [], collections.Counter()
    for _ in range(5):
        block = divergence.Block()
        for _ in range(4):
            texts = [" ".join(rng.choice(["a", "b", "cc", "é", "zz"]) for _ in range(rng.randrange(9))) for _ in range(3)]
            groups = [(rng.choice("xy"), rng.choice("st")) for _ in texts]
            block.add(pa.array(texts, pa.large_string()), groups)
            for t, g in zip(texts, groups, strict=True):
                want.update((w, g) for w in t.split())
        runs.append(block.run())
    one = divergence.heap_merged(runs)
    assert one.terms == sorted(one.terms)
    assert want == {(one.terms[t], one.groups[g]): c for t, g, c in zip(one.term, one.group, one.count, strict=True)}


# 12: document fingerprints


def test_fingerprints_equal_sequential_ones(documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
    found = fingerprints.edit_fingerprints(documents)
    got = {r.doc_id: r for r in found.collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (fingerprints.fingerprint(x) for x in (text, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, after))
    long_ = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long_]) > 0.98
    assert 0.4 < np.mean([r.near_edited for r in long_]) < 0.6 and np.mean([r.near_next for r in long_]) < 0.05


def walked(text):
    """Samples of a walk, step by step."""
    points = fingerprints.code_points(text)
    classes, bits, place, places = fingerprints._classes(points), fingerprints._bits(), 0, []
    while place < len(text):
        places.append(place)
        place += bits[classes[place]][len(places) - 1 & 4095]
    return points, places


@pytest.mark.parametrize("size", [1, 2, 3, 50, 40_000])
def test_samples_are_the_least_ranks_of_the_whole_walk(size):
    rng = random.Random(size)
    text = "".join(rng.choice("abcdefgh éß漢") for _ in range(size))
    points, places = walked(text)
    x = np.arange(1, len(places) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        ranks = [fingerprints._words.mix(fingerprints._words.mix(x) + np.uint64(k) * np.uint64(0xD1B54A32D192ED03)) for k in range(fingerprints.SAMPLES)]
    want = fingerprints.digits(points, np.array([places[int(r.argmin())] for r in ranks]))
    assert fingerprints.fingerprint(text) == want
    own = fingerprints.printed(text)
    for following in ("", "other text " * size, text):
        edited = fingerprints.edited_text(text, following)
        assert fingerprints.edited_print(own, edited) == fingerprints.fingerprint(edited)


def test_few_edits_move_a_fingerprint_little():
    rng = random.Random(4)
    near, far = [], []
    for _ in range(20):
        text = "".join(rng.choice("etaoinshrdlu    ") for _ in range(4000))
        k = rng.randrange(1000, 3000)
        near.append(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(text[:k] + "x" + text[k + 1 :] + "y")))
        far.append(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(text[::-1])))
    assert np.median(near) > 0.9 and max(far) < 0.2


@pytest.mark.parametrize("block", [16, 4096])
def test_bands_find_what_all_pairs_find(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(9)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(128)) for _ in range(6)]
    prints = set(base)
    for _ in range(150):  # long chains of small changes
        x = list(rng.choice(sorted(prints)))
        for k in rng.sample(range(128), rng.randrange(1, 40)):
            x[k] = rng.choice("0123456789abcdef")
        prints.add("".join(x))
    prints = sorted(prints)
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if fingerprints.likeness(prints[a], prints[b]) >= fingerprints.NEAR:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {x: prints[root(k)] for k, x in enumerate(prints)}
    df = spark.createDataFrame([(x,) for x in prints + prints[:5]], "fingerprint string")
    assert {r.fingerprint: r.group for r in fingerprints.near_groups(df).collect()} == want and 1 < len(set(want.values())) < len(want)


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    got = fingerprints.edit_fingerprints(odd_docs).collect()
    texts = sorted(r.text or "" for r in odd_docs.collect())
    assert sorted(fingerprints.fingerprint(t) for t in texts) == sorted(r.fingerprint for r in got)
    assert sorted(map(len, texts)) == sorted(r.n_chars for r in got)
    assert fingerprints.edit_fingerprints(no_docs).count() == 0
    one = fingerprints.edit_fingerprints(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aloal").hexdigest()


# 13: spelling variants


def spelled(rows, noise=199, least=5, form=5):
    """word -> (form, root, n, n_near, form_n)."""
    count = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    holes = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
    near = {w: set().union(*(holes[w[:k] + "*" + w[k + 1 :]] for k in range(len(w)))) - {w} for w in words}
    for w in words:
        for less in {w[:k] + w[k + 1 :] for k in range(len(w))} & set(words):
            near[w].add(less)
            near[less].add(w)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    forms = {w: b if b and words[b] >= form * words[w] else None for w, b in best.items()}
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), forms[w] and words[forms[w]])
    return out


def spelling_got(found):
    rows = found.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_equal_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = spelled(rows)
    assert spelling_got(spelling.spelling_variants(documents)) == want and sum(v[0] is not None for v in want.values()) > 10


@pytest.mark.parametrize("cell, sample", [(20_000, 200_000), (25, 400), (7, 60)])
def test_cells_lose_no_near_word(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "LEAF", 4)
    rng = random.Random(cell)
    count = {}
    for _ in range(60):
        w = "".join(rng.choice("abcdeéÿz") for _ in range(rng.randrange(6, 11)))
        count[w] = rng.randrange(5, 4000)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("xyz") + w[k + 1 :]])
            if len(w) >= 6:
                count.setdefault(w, rng.randrange(5, 300))
    count.update({"".join(p): 9 for p in ("abcdef", "abcdfe", "abdcef", "bacdef", "abcdeg")})  # equal vectors
    rows = [(0, " ".join(w for w, n in count.items() for _ in range(n)))]
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert spelling_got(spelling.with_roots(spelling.near_words(words, cell=cell, sample=sample))) == spelled(rows, noise=None)


def test_a_cell_that_no_cut_parts_is_dealt_out(spark):
    import itertools

    words = sorted({"".join(p) for p in itertools.permutations("aabbcd")})  # one vector
    count = {w: 5 + k for k, w in enumerate(words)} | {"aabbce": 10_000, "aabbc": 7}
    count.pop("aabbc")
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    want = spelled([(0, " ".join(w for w, n in count.items() for _ in range(n)))], noise=None)
    assert spelling_got(spelling.with_roots(spelling.near_words(df, cell=10))) == want


def test_chains_of_forms_are_followed(spark):
    chain = [("wordaa", 5), ("wordab", 30), ("wordcb", 200), ("wordcd", 1500), ("xordcd", 9000), ("xyrdcd", 60_000)]
    found = spelling.with_roots(spelling.near_words(spark.createDataFrame(chain, "word string, n long")))
    assert {r.word: r.root for r in found.collect()} == {w: "xyrdcd" for w, _ in chain}


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    extra = [(k, "ÀÉÖ×÷Þßàÿ ÀÉÖ×÷Þßàÿ, ÀÉÖ×÷Þßàÿx Überfluß überfluß" + "x" * 5000) for k in range(6)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    assert spelling_got(spelling.spelling_variants(docs)) == spelled(rows + extra)
    assert spelling_got(spelling.spelling_variants(odd_docs)) == spelled(rows)
    assert spelling.spelling_variants(no_docs).count() == 0
