"""Every operator on odd rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonespan.llm import decontaminate, html, katz, language, packing, quality, simhash, substring, tools, urls


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta"), (1, None), (2, ""), (3, "three short words"), (None, "nobody knows this item at all today")], "item_id long, text string")


OPERATORS = {
    "katz": lambda d, b: katz.katz_scores(d, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)[0],
    "quality": lambda d, b: quality.score_documents(d),
    "simhash": lambda d, b: simhash.simhash_components(d),
    "language": lambda d, b: language.identify(d, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)[0],
    "packing": lambda d, b: packing.pack(d),
}
FILTERS = {
    "keep_documents": lambda d, b: quality.keep_documents(d),
    "keep_one": lambda d, b: simhash.keep_one(d),
    "cut_repeats": lambda d, b: substring.cut_repeats(d),
    "drop_leaks": lambda d, b: decontaminate.drop_leaks(d, b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(name, odd_docs, no_docs, bench):
    got = OPERATORS[name](odd_docs, bench)
    n = got.where("piece = 0").count() if name == "packing" else got.count()
    assert n == odd_docs.count()
    assert OPERATORS[name](no_docs, bench).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(name, odd_docs, no_docs, bench):
    got = FILTERS[name](odd_docs, bench)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    # inner names do not leak into the columns of the same name
    assert all(r["_key"] == r["fp"] == r["_spans"] == (None if r.doc_id is None else str(r.doc_id)) for r in rows)
    assert FILTERS[name](no_docs, bench).count() == 0


def test_keep_one_of_repeated_rows(odd_docs):
    rows = simhash.keep_one(odd_docs).collect()
    texts = [r.text for r in rows if r.text and r.text.startswith("w")]
    assert len(texts) == len(set(texts))
    assert 50 not in {r.doc_id for r in rows}


def test_passage_stays_once(odd_docs):
    rows = {r.doc_id: r for r in substring.cut_repeats(odd_docs).collect() if r.doc_id in (7, 8)}
    assert rows[8].text != odd_docs.where("doc_id = 8").first().text and rows[8].n_chars == len(rows[8].text)
    assert rows[7].text == odd_docs.where("doc_id = 7").first().text


def test_katz_without_training_rows(odd_docs):
    got = katz.katz_scores(odd_docs, F.lit(False))[0].agg(F.max("score"), F.max("train_tokens")).first()
    assert tuple(got) == (0.0, 0)


def test_language_without_labels(odd_docs):
    got = language.identify(odd_docs, F.lit(False))[0]
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_leaks_of_short_items(spark, bench):
    docs = spark.createDataFrame([(1, "so THREE short words here"), (2, "three short, words"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 3)]
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs, bench.where("false")).count() == 3


def test_items_are_taken_in_turns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 2)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(5)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    got = decontaminate.find_leaks(docs, items)
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got.collect()) == [(k, k, 1.0) for k in range(5)]
    assert decontaminate.drop_leaks(docs, items).count() == 0


def test_pages_and_addresses(spark):
    rows = [(1, None, None, "x"), (2, "", "", "y"), (None, "no scheme", "<p>text", "z"), (1, None, None, "x"), (3, "HTTP://A.Example.COM/en/7?x", "<article><p>" + "long text. " * 50_000, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    text = html.extract(pages)
    assert text.count() == 5 and text.where("text is null").count() == 0
    assert text.where("page_id = 3").first().n_chars == len("long text. " * 50_000) - 1
    got = {r.id: r for r in urls.judge(pages).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("", "", None, "allow")
    assert html.extract(pages.where("false")).count() == urls.judge(pages.where("false")).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "again"), (1, 2, "user", None), (None, 0, "user", "x"), (2, None, "user", "x"), (2, 1, None, "x"), (3, 0, "user", "z" * 300_000)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clashing = talk.withColumns({c: F.lit(1) for c in ("result", "call_id", "d", "system", "need", "needs", "name", "arguments", "first", "given")})
    got = {r.call_id: r for r in tools.link_conversations(clashing).collect()}
    assert set(got) == {"1:0", "1:2", "3:0"}
    assert got["1:0"].n_results == 2 and got["1:0"].result == "again"
    assert not got["1:2"].valid and got["1:2"].n_results == 0 and {got["1:0"].topo_rank, got["1:2"].topo_rank} == {0, 1}
    assert tools.link_conversations(talk.where("false")).count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == rows.columns
            docs = spark.createDataFrame(docs.collect(), rows.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_tables_lie_in_the_shared_folder(spark):
    from tonespan.llm import _tables

    df = spark.range(50).withColumn("k", F.col("id") % 5)
    made = _tables.bucketed(df, "t", "id", "k")
    assert made.location.startswith(_tables.shared_dir(spark)) and spark.table(made.table_name).count() == 50
    assert spark.sql(f"DESCRIBE TABLE EXTENDED {made.table_name}").where("col_name = 'Location'").first()["data_type"].rstrip("/") == made.location
    _tables.drop(made)
    assert not spark.catalog.tableExists(made.table_name)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(made.location)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tonespan.llm import _tables

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="all executors share"):
        _tables.shared_dir(SimpleNamespace(sparkContext=Context()))
