"""Stand-ins over the driver's tables: they exercise the operators and are not voice data.

Each has the same columns as a SQL common table expression of the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
SPAN_SECONDS = 600.0
LONG = 3_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', {column})") / F.lit(1e6)


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("rec"), F.col("event_type").alias("speaker"), seconds("ts").alias("t"), "value")


def turns(spark, sf_dir) -> DataFrame:
    """rec = user, speaker = event type, end = start + value * 600."""
    return events(spark, sf_dir).select("event_id", "rec", "speaker", F.col("t").alias("start"), (F.col("t") + F.col("value") * SPAN_SECONDS).alias("end"))


def durations(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("rec").distinct().withColumn("duration", F.lit(LONG))


def segments(spark, sf_dir) -> DataFrame:
    """Sorted, disjoint: the joined spans of clicks and views."""
    from tonespan.operators import spans

    return spans.union(turns(spark, sf_dir).where("speaker in ('click', 'view')").select("rec", "start", "end"), ["rec"])


def levels(spark, sf_dir) -> DataFrame:
    """rec = user % 16, i = place by time, db from the value."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("rec"), "ts", "event_id", F.col("event_type").alias("kind"), "value")
    place = F.row_number().over(Window.partitionBy("rec").orderBy("ts", "event_id")) - 1
    return rows.select("rec", place.cast("long").alias("i"), "kind", "value", (20 * F.log10(F.greatest("value", F.lit(1e-10)))).alias("db"))


def voiceprints(spark, sf_dir) -> DataFrame:
    """rec = chunk = id div 3, local = id % 3."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("chunk"), (F.col("vec_id") % 3).alias("local"), F.col("label").alias("speaker"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def scores(spark, sf_dir) -> DataFrame:
    """Window scores: chunk, frame, k, score."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 64).alias("chunk"), (F.col("l_orderkey") % 64 + F.col("l_linenumber")).alias("frame"), (F.col("l_suppkey") % 5).alias("k"), F.col("l_discount").alias("score")
    )


def frames(spark, sf_dir) -> DataFrame:
    """Voice frames: pitch in semitones, formants, loudness and harmonics from the values."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        (F.col("user_id") % 16).alias("rec"),
        (F.col("user_id") % 3).cast("int").alias("src"),
        seconds("ts").alias("t"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(v / 8).alias("semitones"),
        (300 + v * 2).alias("f1"),
        (900 + v * 4).alias("f2"),
        (2000 + v * 5).alias("f3"),
        v.alias("loudness"),
        (v - 20).alias("hnr"),
    )


SQL = {
    "ev": f"ev AS (SELECT event_id, user_id AS rec, event_type AS speaker, (epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) / 1e6 AS t, value FROM events)",
    "turns": f"turns AS (SELECT event_id, rec, speaker, t AS s, t + value * {SPAN_SECONDS} AS e FROM ev)",
    "segs": """cv AS (SELECT rec, s, e FROM turns WHERE speaker IN ('click', 'view')),
cv1 AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cv),
cv2 AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cv1),
segs0 AS (SELECT rec, min(s) AS s, max(e) AS e FROM cv2 GROUP BY rec, g),
segs AS (SELECT rec, s, e, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM segs0)""",
    "lv": "lv AS (SELECT user_id % 16 AS rec, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS i, event_type AS kind, value, 20 * log10(greatest(value, 1e-10)) AS db FROM events)",
    "vp": "vp AS (SELECT vec_id, vec_id // 3 AS chunk, vec_id % 3 AS local, label AS speaker, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)",
    "sc": "sc AS (SELECT l_orderkey % 64 AS chunk, l_orderkey % 64 + l_linenumber AS frame, l_suppkey % 5 AS k, l_discount AS score FROM lineitem)",
    "fr": f"""fr AS (SELECT event_id, user_id % 16 AS rec, user_id % 3 AS src, (epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) / 1e6 AS t,
CASE WHEN event_type = 'error' THEN 0.0 ELSE value / 8 END AS semitones, 300 + value * 2 AS f1, 900 + value * 4 AS f2, 2000 + value * 5 AS f3, value AS loudness, value - 20 AS hnr FROM events)""",
}
#: Expressions that others need.
NEEDS = {"turns": ["ev"], "segs": ["ev", "turns"]}


def sql(body: str, *names: str) -> str:
    """A query over the named stand-ins; ``body`` may begin with expressions of its own
    (then it starts with a comma)."""
    wanted: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    if not wanted:
        return "WITH " + body.lstrip(", ")
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + body
