"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonespan.llm import decontaminate, divergence, fingerprints, html, katz, language, packing, quality, simhash, spelling, substring, tools, urls
from tonespan.llm._tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op5_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_quality_rules(spark, sf_dir):
    """Counts, posterior quality and verdict of every document."""
    found = quality.score_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "quality")


@query
def op10_best_fit_packing(spark, sf_dir):
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_url_filters(spark, sf_dir):
    """Host, path, fitting rule and verdict of every page's address."""
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


ORACLE_SQL["op7_url_filters"] = urls.oracle()


@query
def op4_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op8_benchmark_decontamination(spark, sf_dir):
    """Best matching window of each document and benchmark item that reach the similarity."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _fold(modulus: int):
    """crc32 of the id's text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


@query
def op6_language_id(spark, sf_dir):
    """Predicted language of every document; a quarter of the documents is held out."""
    found, _ = language.identify(table(spark, sf_dir, "documents"), _fold(4) != 2)
    held = F.coalesce(_fold(4) == 2, F.lit(True)).alias("held_out")
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held, "lang_pred", "score")


@query
def op1_katz_backoff(spark, sf_dir):
    """Log10 probability of every document by the model of nine tenths of them."""
    held = F.coalesce(_fold(10) == 0, F.lit(True))
    scores, _ = katz.katz_scores(table(spark, sf_dir, "documents"), ~held)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_substring_dedup(spark, sf_dir):
    """Spans of every document that repeat a passage which another place keeps."""
    spans = substring.merged_spans(substring.repeated_spans(table(spark, sf_dir, "documents")))
    return spans.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")


@query
def op3_tool_call_linking(spark, sf_dir):
    """Linked calls of all conversations: user turns as calls, answers as results."""
    linked = tools.link_conversations(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "call_id", "turn", "name", "n_results", "arguments", "valid", "error", "topo_rank", "linked_json")


ORACLE_SQL["op3_tool_call_linking"] = tools.oracle()


@query
def op11_source_divergence(spark, sf_dir):
    """How far each source differs from the others of its language, and in which terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence"] = divergence.oracle()


@query
def op12_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, their likeness, and the least
    fingerprint of those that are near."""
    found = fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.join(fingerprints.near_groups(found), "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group")


@query
def op13_spelling_variants(spark, sf_dir):
    """Words, their near words and the forms that they vary."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
