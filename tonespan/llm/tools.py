"""Linking of tool calls and their results in conversations.

Calls and results are joined by call identifier with a hash join, arguments are validated
against the tool's JSON schema, the calls of a conversation are ordered topologically by
their dependencies, and each call is serialised as canonical JSON (sorted keys, no spaces,
numbers in shortest form).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespan.llm import _words
from tonespan.llm._tables import release, staged

#: Turns of a conversation that are ranked together.
RUN = 500

#: Calls of a conversation that are ordered in one task, by identifiers alone; larger
#: conversations are ordered in rounds.
TOGETHER = 50_000
#: Bytes of results that a task of the hash join holds.
HASHED_BYTES = 64 << 20

#: Schemas of the tools that turns of the ``conversations`` table are read as.
TURN_SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "position"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "position": {"type": "integer", "minimum": 0}, "system": {"type": ["string", "null"]}},
    },
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "lookup": {
        "type": "object",
        "required": ["key"],
        "additionalProperties": False,
        "properties": {"key": {"type": "string", "minLength": 1}, "depth": {"type": "integer", "minimum": 0}},
    },
}

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
}


def _same(a, b) -> bool:
    return canonical(a) == canonical(b)


def violations(value, schema, path: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema (the keywords below; others are not checked)."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{path}: nothing allowed"]
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds if k in _TYPES):
            return [f"{path}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{path}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{path}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    if _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf) or value <= schema.get("exclusiveMinimum", -math.inf):
            out.append(f"{path}: too small")
        if value > schema.get("maximum", math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{path}: too large")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{path}: too few items")
        if len(value) > schema.get("maxItems", math.inf):
            out.append(f"{path}: too many items")
        for k, x in enumerate(value):
            out += violations(x, schema.get("items", True), f"{path}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is not True:
                out += [f"{path}.{k}: not known"] if schema["additionalProperties"] is False else violations(value[k], schema["additionalProperties"], f"{path}.{k}")
    return out


def canonical(value) -> str:
    """One text for equal JSON values: sorted keys, no spaces, whole numbers without a
    fraction, no escapes but those that JSON needs."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked(name: str | None, arguments: str | None, schemas: dict) -> tuple[str | None, bool, str | None]:
    """(canonical arguments, valid, error) of one call; without valid JSON no arguments."""
    if name not in schemas:
        error = "unknown tool"
    else:
        error = None
    try:
        value = json.loads(arguments) if arguments is not None else None
        text = canonical(value)
    except (ValueError, RecursionError):
        return None, False, error or "not JSON"
    if error is None:
        found = violations(value, schemas[name])
        error = "; ".join(found) if found else None
    return text, error is None, error


_LINKED = "linked_json string, arguments string, valid boolean, error string"


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row for every call: conv_id, call_id, turn, name, n_results, result, arguments
    (canonical), valid, error, linked_json (canonical).

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text); ``results``: conv_id,
    call_id, turn, result. They meet by (conv_id, call_id): of several results the first
    turn counts (ties: the least text) and ``n_results`` tells how many there were, added
    up before the join, so that a repeated identifier multiplies no rows. A call without a
    result has a null one and n_results 0; results without a call are dropped; null
    identifiers never meet. The results of a partition are held in memory for that, so there
    are as many partitions as their size needs. Repeated calls are each linked. Invalid JSON, unknown tools
    and schema violations keep their row, with valid false and the error.
    """
    held = results.agg(F.coalesce(F.sum(F.length("result").cast("long") + 64), F.lit(0))).first()[0]
    tasks = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(held) // HASHED_BYTES)
    first = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "result")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    met = calls.select("conv_id", "call_id", "turn", "name", F.col("arguments").cast("string").alias("given")).repartition(tasks, "conv_id", "call_id").join(
        first.select("conv_id", "call_id", F.col("first.result").alias("result"), F.col("first.turn").alias("result_turn"), "n_results").repartition(tasks, "conv_id", "call_id").hint("shuffle_hash"), ["conv_id", "call_id"], "left"
    )
    met = met.select("conv_id", "call_id", "turn", "name", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "result", "result_turn", "given")
    names = ["conv_id", "call_id", "turn", "name", "n_results", "result"]
    kept = [f for f in met.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "given"):
            rows = batch.to_pylist()
            out = []
            for r in rows:
                text, valid, error = checked(r["name"], r["given"], schemas)
                linked = {"id": r["call_id"], "name": r["name"], "arguments": json.loads(text) if text is not None else r["given"], "result": r["result"]}
                out.append((canonical(linked), text, valid, error))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            more = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*[f.name for f in kept], "linked_json", "arguments", "valid", "error"])

    more = T._parse_datatype_string(_LINKED)
    return met.mapInArrow(run, T.StructType([*kept, *more.fields]))


def _turn_ranks(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, topo_rank) by turn, then identifier. A long conversation is ranked
    in runs of turns, whose sizes are added up, so that no conversation is sorted in one
    task."""
    runs = nodes.withColumn("run", F.floor(F.coalesce("turn", F.lit(-1)) / RUN))
    sizes = runs.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn", "call_id")) - 1
    return runs.withColumn("place", place).join(first, ["conv_id", "run"]).select("conv_id", "call_id", (F.col("first") + F.col("place")).cast("int").alias("topo_rank"))


def _depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, depth): the length of the longest chain of needs; -1 on a
    cycle or after one. Calls with nothing left to wait for go, round by round."""
    spark = nodes.sparkSession
    waiting = staged(nodes, "calls")
    edges = staged(edges, "needs")
    found = []
    depth = 0
    while True:
        free = staged(waiting.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"), "free")
        if free.isEmpty():
            break
        found.append(free.withColumn("depth", F.lit(depth)))
        waiting = staged(waiting.join(free.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "calls")
        gone = free.select("conv_id", F.col("call_id").alias("need"))
        edges = staged(edges.join(gone, ["conv_id", "need"], "left_anti").select("conv_id", "call_id", "need"), "needs")
        depth += 1
        if depth % 50 == 0:  # a long chain: keep the plan of the result short
            found = [staged(_together(found), "depths")]
    release(spark)
    return _together([*found, waiting.withColumn("depth", F.lit(-1))])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _small_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, topo_rank) of conversations of at most TOGETHER calls."""
    needs = edges.groupBy("conv_id", "call_id").agg(F.collect_list("need").alias("needs"))
    rows = nodes.join(needs, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "turn", "needs")
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        ids = table["call_id"].to_pylist()
        turns = table["turn"].to_pylist()
        place = {x: k for k, x in enumerate(ids)}
        needs = [[place[x] for x in own or ()] for own in table["needs"].to_pylist()]
        waiting = [len(x) for x in needs]
        after: list[list[int]] = [[] for _ in ids]
        for k, own in enumerate(needs):
            for x in own:
                after[x].append(k)
        depth = [-1] * len(ids)
        free = [k for k, n in enumerate(waiting) if not n]
        level = 0
        while free:
            now = []
            for k in free:
                depth[k] = level
                for x in after[k]:
                    waiting[x] -= 1
                    if not waiting[x]:
                        now.append(x)
            free, level = now, level + 1
        rank = [-1] * len(ids)
        done = [k for k in range(len(ids)) if depth[k] >= 0]
        for r, k in enumerate(sorted(done, key=lambda k: (depth[k], turns[k] is not None, turns[k], ids[k]))):
            rank[k] = r
        return pa.table({"conv_id": table["conv_id"], "call_id": table["call_id"], "topo_rank": pa.array(rank, pa.int32())})

    return rows.groupBy("conv_id").applyInArrow(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, topo_rank int")


def order_calls(linked: DataFrame, dependencies: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """``linked`` with ``topo_rank``: the calls of a conversation in an order in which each
    follows what it depends on. Where the order by turn, then identifier does so, it is
    taken. Else the longest chain of needs before a call counts first; a call on a cycle,
    or after one, has rank -1.

    ``dependencies``: conv_id, call_id, needs (identifiers; those that are no call of the
    conversation are ignored). Calls of no conversation (null) have no rank; repeated
    identifiers share a rank. ``calls``: the calls that ``linked`` was made of, if they are
    at hand, so that it need not be made twice.
    """
    known = "conv_id is not null and call_id is not null"
    nodes = (linked if calls is None else calls).where(known).groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    nodes = staged(nodes, "calls")
    needs = dependencies.where(known).select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    of_need = nodes.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = needs.join(of_need, ["conv_id", "need"]).join(nodes, ["conv_id", "call_id"])
    late = edges.where(F.struct("need_turn", "need") >= F.struct("turn", "call_id")).select("conv_id").distinct()
    late = staged(late, "out-of-turn")
    ranks = _turn_ranks(nodes.join(late, "conv_id", "left_anti"))
    if not late.isEmpty():
        mine, needs = nodes.join(late, "conv_id", "left_semi"), edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "need")
        large = staged(mine.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("conv_id"), "large-conversations")
        ranks = ranks.unionByName(_small_ranks(mine.join(large, "conv_id", "left_anti"), needs.join(large, "conv_id", "left_anti")))
        if not large.isEmpty():
            ranks = ranks.unionByName(_ranks_in_rounds(mine.join(large, "conv_id", "left_semi"), needs.join(large, "conv_id", "left_semi")))
    return linked.join(ranks, ["conv_id", "call_id"], "left")


def _ranks_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, topo_rank) of conversations of any size."""
    deep = staged(_depths(nodes, edges), "depths")
    sizes = deep.where("depth >= 0").groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "depth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("conv_id", "depth").orderBy("turn", "call_id")) - 1
    placed = deep.withColumn("place", place).join(first, ["conv_id", "depth"], "left")
    return placed.select("conv_id", "call_id", F.coalesce(F.col("first") + F.col("place"), F.lit(-1)).cast("int").alias("topo_rank"))


def _digest(call_id):
    """Four hexadecimal digits of the identifier's MD5, as a number."""
    return F.conv(F.substring(F.md5(call_id), 1, 4), 16, 10).cast("int")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, dependencies) from plain turns, for a table without tool calls: each
    user turn is a call with the identifier ``conv_id:turn``, the assistant turn after it is
    the result that names it. A digest d of the identifier chooses what real calls vary in:

    the tool is ``reply`` (d mod 3 = 0; the prompt, its position and the conversation's first
    system turn), ``search`` (1; the text and a limit of d mod 60, of which some are not
    allowed) or ``lookup`` (2; the text and a depth of d mod 5, the word "deep" instead of
    4, which is not allowed, and for d mod 11 = 0 a property that is not known);

    a call needs the call of two turns before; for d mod 16 = 0 it needs the one of two turns
    after instead, and that one, unless its own d mod 3 is 0, then needs nothing. Where it
    is, the two are a cycle. A null text gives a null argument.
    """
    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text").cast("string").alias("text"))

    def call_id(turn):
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    def json_of(text):
        listed = F.to_json(F.array(text))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    user, assistant = rows.where((F.col("role") == "user") & known), rows.where((F.col("role") == "assistant") & known)
    system = rows.where((F.col("role") == "system") & known).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("first")).select("conv_id", F.col("first.text").alias("system"))
    turn, d = F.col("turn"), F.col("d")
    asked = user.withColumn("call_id", call_id(turn)).withColumn("d", _digest(F.col("call_id"))).join(system, "conv_id", "left")
    text = json_of(F.col("text"))
    reply = F.concat(F.lit('{"prompt":'), text, F.lit(',"position":'), turn.cast("string"), F.lit(',"system":'), json_of(F.col("system")), F.lit("}"))
    search = F.concat(F.lit('{"query":'), text, F.lit(',"limit":'), (d % 60).cast("string"), F.lit("}"))
    lookup = F.concat(F.lit('{"key":'), text, F.lit(',"depth":'), F.when(d % 5 == 4, '"deep"').otherwise((d % 5).cast("string")), F.when(d % 11 == 0, ',"note":true').otherwise(""), F.lit("}"))
    name = F.when(d % 3 == 0, "reply").when(d % 3 == 1, "search").otherwise("lookup")
    arguments = F.when(d % 3 == 0, reply).when(d % 3 == 1, search).otherwise(lookup)
    calls = asked.select("conv_id", "call_id", "turn", name.alias("name"), arguments.alias("arguments"))
    results = assistant.select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("result"))
    before = _digest(call_id(turn - 2)) % 16 == 0
    needs = F.when(d % 16 == 0, F.array(call_id(turn + 2))).when(before & (d % 3 != 0), F.array().cast("array<string>")).otherwise(F.array(call_id(turn - 2)))
    dependencies = user.withColumn("call_id", call_id(turn)).withColumn("d", _digest(F.col("call_id"))).select("conv_id", "call_id", needs.alias("needs"))
    return calls, results, dependencies


def link_conversations(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """Linked, validated and ordered calls of a table of plain turns."""
    calls, results, needs = turns_as_calls(conversations)
    return order_calls(link_calls(calls, results, schemas or TURN_SCHEMAS), needs, calls)


def oracle() -> str:
    """DuckDB SQL of the query on plain turns: the same calls, checks and order."""
    digest = "CAST('0x' || substr(md5({}), 1, 4) AS INT)"
    return f"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, {digest.format("conv_id || ':' || turn")} AS d, {digest.format("conv_id || ':' || (turn - 2)")} AS d_before
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
sy AS (SELECT conv_id, first(text ORDER BY turn NULLS FIRST, text NULLS FIRST) AS system FROM conversations WHERE role = 'system' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
re AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, first(text ORDER BY turn, text NULLS FIRST) AS result, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
ca AS (SELECT u.*, CASE d % 3 WHEN 0 THEN 'reply' WHEN 1 THEN 'search' ELSE 'lookup' END AS name, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS t,
  coalesce(CAST(to_json(system) AS VARCHAR), 'null') AS s, CASE WHEN text IS NULL THEN 'not string' WHEN text = '' THEN 'too short' END AS bad FROM u LEFT JOIN sy USING (conv_id)),
ar AS (SELECT *, CASE d % 3 WHEN 0 THEN '{{"position":' || turn || ',"prompt":' || t || ',"system":' || s || '}}' WHEN 1 THEN '{{"limit":' || d % 60 || ',"query":' || t || '}}'
  ELSE '{{"depth":' || CASE WHEN d % 5 = 4 THEN '"deep"' ELSE CAST(d % 5 AS VARCHAR) END || ',"key":' || t || CASE WHEN d % 11 = 0 THEN ',"note":true' ELSE '' END || '}}' END AS arguments,
  CASE d % 3 WHEN 0 THEN concat_ws('; ', CASE WHEN turn < 0 THEN '$.position: too small' END, '$.prompt: ' || bad)
  WHEN 1 THEN concat_ws('; ', CASE WHEN d % 60 < 1 THEN '$.limit: too small' WHEN d % 60 > 50 THEN '$.limit: too large' END, '$.query: ' || bad)
  ELSE concat_ws('; ', CASE WHEN d % 5 = 4 THEN '$.depth: not integer' END, '$.key: ' || bad, CASE WHEN d % 11 = 0 THEN '$.note: not known' END) END AS found FROM ca),
no AS (SELECT conv_id, call_id, min(turn) AS turn, any_value(d) AS d, any_value(d_before) AS d_before FROM u GROUP BY ALL),
ed AS (SELECT a.conv_id, a.call_id, a.turn, b.call_id AS need, b.turn AS need_turn FROM no a JOIN no b ON a.conv_id = b.conv_id
  AND b.turn = CASE WHEN a.d % 16 = 0 THEN a.turn + 2 WHEN a.d_before % 16 = 0 AND a.d % 3 <> 0 THEN NULL ELSE a.turn - 2 END),
la AS (SELECT DISTINCT conv_id FROM ed WHERE need_turn >= turn),
de AS (SELECT conv_id, call_id, turn, 0 AS depth FROM no WHERE (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM ed)
  UNION ALL SELECT e.conv_id, e.call_id, e.turn, de.depth + 1 FROM ed e JOIN de ON e.conv_id = de.conv_id AND e.need = de.call_id),
ra AS (SELECT no.conv_id, no.call_id, CASE WHEN no.conv_id NOT IN (SELECT conv_id FROM la) THEN row_number() OVER (PARTITION BY no.conv_id ORDER BY no.turn, no.call_id) - 1
  WHEN depth IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY no.conv_id ORDER BY depth NULLS LAST, no.turn, no.call_id) - 1 END AS topo_rank FROM no LEFT JOIN de USING (conv_id, call_id))
SELECT ar.conv_id, ar.call_id, ar.turn, ar.name, coalesce(n_results, 0) AS n_results, arguments, found = '' AS valid, nullif(found, '') AS error, CAST(topo_rank AS INT) AS topo_rank,
  '{{"arguments":' || arguments || ',"id":' || CAST(to_json(ar.call_id) AS VARCHAR) || ',"name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}}' AS linked_json
FROM ar LEFT JOIN re USING (conv_id, call_id) LEFT JOIN ra USING (conv_id, call_id)"""
