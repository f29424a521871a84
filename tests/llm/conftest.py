import random

import pytest

#: Columns whose names the operators use inside.
CLASHING = ["fp", "key", "id", "node", "component", "_key", "_spans", "_row", "_text", "pattern", "quality", "hits", "spans", "bucket", "block", "rank", "salt", "lang_pred", "score", "_html", "kind"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids with
    other texts, and further columns whose names clash with inner ones."""
    rng = random.Random(7)
    long_ = words(rng, 60_000, 50_000)
    passage = words(rng, 60)
    texts = [None, "", " \n\t ", "one", "two words", long_, words(rng, 120), words(rng, 40) + " " + passage + " " + words(rng, 40), words(rng, 50) + "\n" + passage + " " + words(rng, 30), "ÀÉ ß İ 漢字 " * 30, "a\x00b \x1c c\x85d e", "same " * 500]
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, words(rng, 80), "de", None, None), (None, words(rng, 90), "de", "src1", 3), (None, None, None, None, None), (50, rows[6][1], "en", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"cast(doc_id as string) as `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
