"""Weak supervision of document quality.

Rules vote good, bad or abstain. Expectation-maximisation over the histogram of vote
patterns (at most 2^rules rows, whatever the size of the corpus) estimates how each rule
votes on good and on bad documents; the posterior probability of "good" replaces a filter
that every rule must pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespan.llm import _words
from tonespan.llm._tables import staged

ABSTAIN, GOOD, BAD = 0, 1, 2
KEEP_FROM = 0.5
WINDOW = 5
#: Rules that vote bad or abstain: measure, ranges in which they vote bad.
BAD_RULES = (
    ("length", ((-np.inf, 9),)),
    ("symbols", ((0.2, np.inf),)),
    ("wordless", ((0.2, np.inf),)),
    ("capitals", ((0.3, np.inf),)),
    ("repeats", ((0.25, np.inf),)),
    ("variety", ((-np.inf, 0.3),)),
    ("duplicate_lines", ((0.4, np.inf),)),
    ("word_length", ((-np.inf, 2.0), (9.0, np.inf))),
    ("marks", ((0.16, np.inf),)),
    ("shouting", ((0.3, np.inf),)),
)
#: Rules that vote good or abstain: all of these measures in range.
GOOD_RULES = (
    ("prose", (("word_length", (3.0, 8.0)), ("symbols", (0, 0.1)), ("wordless", (0, 0.1)), ("capitals", (0, 0.15)), ("marks", (0, 0.16)))),
    ("original", (("variety", (0.4, 1)), ("repeats", (0, 0.2)), ("duplicate_lines", (0, 0.34)))),
)
RULES = (*(name for name, _ in BAD_RULES), *(name for name, _ in GOOD_RULES))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = " \t\n\x0b\x0c\r"


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def measures(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS and the votes (rows x rules) of every text."""
    flat, starts = _words.split(texts)
    n = np.diff(starts)
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, words = _words.coded(flat)
    hashes = _words.word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
    owner = _words.owners(starts)
    places = _words.gram_places(starts, WINDOW, len(hashes))
    window = _words.gram_hashes(hashes, WINDOW)[places] if len(places) else np.zeros(0, np.uint64)
    keyed = _words.pair_hash(owner[places].astype(np.uint64), window)
    _, inverse, count = np.unique(keyed, return_inverse=True, return_counts=True)
    at = places[count[inverse] > 1]
    repeated = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        repeated[at + k] = True
    seen = np.unique(_words.pair_hash(owner.astype(np.uint64), hashes)) if len(hashes) else hashes
    # distinct words of each text: a word's first place in it
    _, first = np.unique(_words.pair_hash(owner.astype(np.uint64), hashes), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(n)) if len(seen) else np.zeros(len(n), np.int64)
    upper = pc.utf8_is_upper(flat).to_numpy(zero_copy_only=False) & (size > 1)
    lines = [[x for x in t.split("\n") if x.strip(_SPACE)] for t in texts.to_pylist()]
    n_lines = np.fromiter(map(len, lines), np.int64, len(n))
    dup = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(n))
    found = {
        "n_words": n,
        "word_chars": _sums(size, starts),
        "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": _sums(repeated.astype(np.int64), starts),
    }
    has_no_letter = ~pc.match_substring_regex(pa.array(words, pa.string()), r"\pL").to_numpy(zero_copy_only=False)
    marks = pc.count_substring_regex(texts, r"[!-/:-@\[-`{-~]").to_numpy(zero_copy_only=False)
    shouts = pc.count_substring(texts, "!").to_numpy(zero_copy_only=False)
    words_or_1 = np.maximum(n, 1)
    value = {
        "length": n.astype(float),
        "symbols": found["n_symbols"] / words_or_1,
        "wordless": _sums(has_no_letter[codes].astype(np.int64), starts) / words_or_1,
        "capitals": _sums(upper.astype(np.int64), starts) / words_or_1,
        "repeats": found["n_repeat_words"] / words_or_1,
        "variety": distinct / words_or_1,
        "duplicate_lines": dup / np.maximum(n_lines, 1),
        "word_length": found["word_chars"] / words_or_1,
        "marks": marks / np.maximum(found["word_chars"], 1),
        "shouting": shouts / words_or_1,
    }
    # a share says little of a short text
    weigh = {"variety": (n >= 20) & (n <= 3000), "duplicate_lines": n_lines >= 3, "capitals": n >= 5, "repeats": n >= 10, "marks": n >= 3, "shouting": n >= 3}
    votes = np.zeros((len(n), len(RULES)), np.int8)
    some = n > 0
    for k, (name, ranges) in enumerate(BAD_RULES):
        x, heard = value[name], weigh.get(name, True) & (some | (name == "length"))
        for low, high in ranges:
            votes[heard & (x >= low) & (x <= high), k] = BAD
    for k, (_, needs) in enumerate(GOOD_RULES, len(BAD_RULES)):
        fits = some.copy()
        for name, (low, high) in needs:
            fits &= ((value[name] >= low) & (value[name] <= high)) | ~np.broadcast_to(weigh.get(name, True), fits.shape)
        votes[fits, k] = GOOD
    return found, votes


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def pattern_votes(codes: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(rules)) % 3


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 200, prior: float = 2.0) -> np.ndarray:
    """Posterior probability of "good" for each vote pattern.

    The class of a document is hidden; given it, rules vote or abstain independently, each
    with its own probability of speaking up. The start doubts every document with a bad
    vote; pseudo-votes (``prior``: a rule speaks up in its own class rather) keep the
    classes from swapping and small tables defined.
    """
    if not len(votes):
        return np.zeros(0)
    speaks = (votes != ABSTAIN).astype(float)
    says_bad = np.arange(votes.shape[1]) < len(BAD_RULES)
    p = np.where((votes == BAD).any(axis=1), 0.1, np.where((votes == GOOD).any(axis=1), 0.9, 0.5))
    total = weight.sum()
    own, other = 0.5 * prior, 0.02 * prior
    for _ in range(rounds):
        g, b = weight * p, weight * (1 - p)
        on_good = (g @ speaks + np.where(says_bad, other, own)) / (g.sum() + prior)
        on_bad = (b @ speaks + np.where(says_bad, own, other)) / (b.sum() + prior)
        share = (g.sum() + 1) / (total + 2)
        log_odds = np.log(share / (1 - share)) + speaks @ np.log(on_good / on_bad) + (1 - speaks) @ np.log((1 - on_good) / (1 - on_bad))
        new = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-9:
            break
    return p


_MEASURED = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("pattern", T.LongType())])


def _measured(docs: DataFrame, keep: list, text_col: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the measures of each text; no shuffle."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = T.StructType(rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "_text", 1 << 20):
            found, votes = measures(_words.as_text(piece.column(piece.num_columns - 1)))
            columns = [*piece.columns[:-1], *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(pattern_codes(votes), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept.names, *_MEASURED.names])

    return rows.mapInArrow(run, T.StructType([*kept.fields, *_MEASURED.fields]))


def _posteriors(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns in order, quality), fitted on the driver from counted patterns: a rule
    speaks up or not, so there are at most 2^rules."""
    counted = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    codes = np.array([r[0] for r in counted], np.int64)
    p = fit(pattern_votes(codes), np.array([r[1] for r in counted], float)) if counted else np.zeros(0)
    return codes, p


def base_failed():
    """The rule that no posterior overrules: too short, or too much of it repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts of COUNTS, pattern, quality, base_failed, kept) of every row.

    A null text has no words: all counts are zero and the base rule fails. Rows with a null
    id and repeated rows are scored like any other; an empty table gives an empty one;
    columns of ``docs`` other than the two named are not read.
    """
    rows = staged(_measured(docs, [F.col(id_col).alias("id")], text_col), "measures")
    made = [(int(c), float(x)) for c, x in zip(*_posteriors(rows.select("pattern")), strict=True)]
    quality = F.broadcast(docs.sparkSession.createDataFrame(made, "pattern long, quality double"))
    return rows.join(quality, "pattern").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def keep_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. The vote patterns are counted in a
    first pass; the second measures again beside the rows, so texts are never shuffled."""
    codes, posterior = _posteriors(_measured(docs, [], text_col).select("pattern"))
    rows = docs.select(F.struct("*").alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _words.text_of(("_row", text_col))
        for piece in _words.slices(batches, ("_row", text_col), 1 << 20):
            found, votes = measures(_words.as_text(read(piece)))
            n = found["n_words"]
            good = posterior[np.searchsorted(codes, pattern_codes(votes))] >= KEEP_FROM
            keep = good & (n >= 10) & (100 * found["n_repeat_words"] <= 20 * n)
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(keep))], ["_row"])

    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
