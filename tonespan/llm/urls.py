"""URL filters: host rules and pattern rules indexed by their rarest literal token.

Pattern rules are written in filter-list form: ``||`` the start of a host label, ``|`` the
start or end of the address, ``^`` a separator or the end, ``*`` anything, a leading ``@@``
an exception. A rule's literal tokens are the runs of letters and digits that must stand
in the address as whole tokens. Each rule is filed under its token that fewest addresses
have; the tokens of an address fetch the candidate rules and only their regular
expressions run. A rule without a literal token is a candidate for every address.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
HOST_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PATTERN_RULES = (
    "||spam-",
    "||cheap-pills.",
    "||casino-",
    "||adult-",
    "||free-bets.",
    "||ads-",
    "||track-",
    "^viagra^",
    "^casino^",
    "^poker^",
    "^porn^",
    "^xxx^",
    "^warez^",
    "^torrent^",
    "^payday-loans^",
    "^free-download^*^crack^",
    "/wp-login.php^",
    "^replica-watches^",
    "@@^responsible-gambling^",
)

#: Characters of all pattern rules up to which the filed rules are broadcast (some 100,000
#: rules); longer lists meet the tokens in a shuffled join.
BROADCAST_CHARS = 4_000_000
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
_LABEL = r"^[a-z0-9+.-]*://(?:[^/?#]*\.)?"


def _lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return _lower(raw), path


def parse_rule(rule: str) -> tuple[str, str, list[str]]:
    """(verdict, regular expression for a lower-cased address, literal tokens)."""
    verdict = "allow" if rule.startswith("@@") else "block"
    body = rule.removeprefix("@@").lower()
    label = body.startswith("||")
    start = not label and body.startswith("|")
    body = body.removeprefix("||") if label else body.removeprefix("|")
    end = body.endswith("|")
    body = body.removesuffix("|")
    parts = {"^": _SEPARATOR, "*": ".*"}
    regex = "".join(parts.get(c) or re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", c) for c in body)
    if body.startswith("^"):
        regex = r"(?:^|[^a-z0-9_.%-]|\.)" + regex[len(_SEPARATOR) :]
    regex = (_LABEL if label else "^" if start else "") + regex + ("$" if end else "")
    tokens = []
    for m in re.finditer("[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("|" if label or start else "*")
        after = body[m.end()] if m.end() < len(body) else ("|" if end else "*")
        if before not in "*%" and after not in "*%":
            tokens.append(m[0])
    return verdict, regex, tokens


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def file_rules(rows: DataFrame, url: Column, pattern_rules: Sequence[str]) -> DataFrame:
    """(token, k, pattern, regex, verdict): every pattern rule under its literal token that
    fewest of the addresses have (ties: the least token), those without one under the empty
    token. The addresses' tokens are counted on the map side and join the rules' tokens."""
    spark = rows.sparkSession
    parsed = [parse_rule(r) for r in pattern_rules]
    listed = spark.createDataFrame(
        [(k, pattern, regex, verdict, tokens) for k, (pattern, (verdict, regex, tokens)) in enumerate(zip(pattern_rules, parsed, strict=True))],
        "k int, pattern string, regex string, verdict string, tokens array<string>",
    )
    wanted = listed.select("k", F.explode("tokens").alias("token"))
    counts = rows.select(F.explode(_tokens(url)).alias("token")).groupBy("token").count().join(_small(wanted.select("token").distinct(), pattern_rules), "token", "left_semi")
    rarest = wanted.join(counts, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return listed.join(rarest, "k", "left").select(F.coalesce("token", F.lit("")).alias("token"), "k", "pattern", "regex", "verdict")


def _small(df: DataFrame, pattern_rules: Sequence[str]) -> DataFrame:
    """Broadcast what comes from the rules, if the rules' characters are few enough."""
    return F.broadcast(df) if sum(map(len, pattern_rules)) <= BROADCAST_CHARS else df


def candidates(rows: DataFrame, address: Column, filed: DataFrame, pattern_rules: Sequence[str]) -> DataFrame:
    """(address, k, pattern, regex, verdict): for each different address the rules that its
    tokens fetch. Beyond the broadcast bound an address takes one of SALTS copies of the
    filed rules, so that a token of very many addresses spreads over as many tasks."""
    words = F.concat(_tokens(F.col("address")), F.array(F.lit("")))
    asked = rows.select(address.alias("address")).distinct().select("address", F.explode(words).alias("token"))
    if sum(map(len, pattern_rules)) <= BROADCAST_CHARS:
        return asked.join(F.broadcast(filed), "token").drop("token")
    salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("address"), F.lit(SALTS)).cast("int"))
    return asked.join(salted, ["token", "salt"]).drop("token", "salt")


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of every row.

    The longest host rule that fits decides (its host or a subdomain, path prefix); else
    the pattern rules: block if one matches and no exception does. ``pattern`` is the first
    matching pattern rule, null if none or if a host rule decided. A null address or one
    without ``://`` has an empty host and path and is allowed unless a pattern matches it;
    null ids, repeated rows, empty tables and further columns do no harm.
    Host rules are few and are sent with the plan. Pattern rules are a table: the tokens of
    each different address fetch candidates by an equality join, only their regular
    expressions run, and the addresses that match join the rows again.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(url)
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("address", _lower(F.coalesce(url, F.lit(""))))
    by_length = sorted(host_rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in by_length]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, by_length, strict=True)], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, by_length, strict=True)], F.lit(None).cast("string"))
    rows = rows.withColumn("rule", rule).withColumn("said", said)

    fetched = candidates(rows.where("said is null"), F.col("address"), file_rules(rows, url, pattern_rules), pattern_rules)
    matched = (
        fetched.where(F.call_function("rlike", F.col("address"), F.col("regex")))
        .groupBy("address")
        .agg(F.min_by("pattern", "k").alias("pattern"), (F.bool_or(F.col("verdict") == "block") & ~F.bool_or(F.col("verdict") == "allow")).alias("blocked"))
    )
    open_ = F.col("said").isNull()
    verdict = F.coalesce("said", F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.join(matched, "address", "left").select("id", "host", "path", "rule", verdict.alias("verdict"), F.when(open_, F.col("pattern")).alias("pattern"))


def oracle(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """DuckDB SQL of the same verdicts, every pattern rule tried on every address."""
    rules = [parse_rule(r) for r in pattern_rules]

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    by_length = sorted(host_rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    cases = [(f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})", h + p, v) for v, h, p in by_length]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {quoted(r)}" for c, r, _ in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, _, v in cases) + " END"
    block = " OR ".join(f"regexp_matches(address, {quoted(x)})" for v, x, _ in rules if v == "block") or "false"
    allow = " OR ".join(f"regexp_matches(address, {quoted(x)})" for v, x, _ in rules if v == "allow") or "false"
    first = "CASE " + " ".join(f"WHEN regexp_matches(address, {quoted(x)}) THEN {quoted(p)}" for (_, x, _), p in zip(rules, pattern_rules, strict=True)) + " END"
    lower = f"'{_UPPER}', '{_UPPER.lower()}'"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(url, {lower}) AS address, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, address, translate(raw, {lower}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, {rule} AS rule, {said} AS said FROM c)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN ({block}) AND NOT ({allow}) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN said IS NULL THEN {first} END AS pattern
FROM d"""
