"""Queries of the span algebra and of timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonespan.operators import spans, timeline
from tonespan.plans import inputs
from tonespan.plans.inputs import LONG, sql

REC = ["rec"]
WIDTH = 20_000.0
QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLE_SQL[run.__name__] = oracle
        return run

    return register


def _out(df, *names):
    return df.select(*[F.round(n, 6).alias(n) if n in ("start", "end", "overlap", "talk", "offset", "source_t", "joined_t", "source_start", "source_end", "t") else n for n in names])


def _part(spark, sf_dir, *speakers):
    return inputs.turns(spark, sf_dir).where(F.col("speaker").isin(*speakers)).select("rec", "start", "end")


@query(sql(""", f AS (SELECT rec, i FROM lv WHERE db > 25), g AS (SELECT rec, i, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS r FROM f)
SELECT rec, min(i) AS "first", max(i) + 1 AS stop FROM g GROUP BY rec, r HAVING count(*) >= 3""", "lv"))
def q01_runs_min_length(spark, sf_dir):
    return spans.runs(inputs.levels(spark, sf_dir), REC, "i", F.col("db") > 25, 3)


_JOIN = """a AS (SELECT rec, speaker, s, e, max(e) OVER (PARTITION BY rec, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM turns),
b AS (SELECT *, sum(CASE WHEN s <= m + 3600.0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a),
joined AS (SELECT rec, speaker, min(s) AS s, max(e) AS e FROM b GROUP BY rec, speaker, g)"""


@query(sql(f', {_JOIN} SELECT rec, speaker, round(s, 6) AS start, round(e, 6) AS "end" FROM joined', "turns"))
def q02_gap_join(spark, sf_dir):
    return _out(spans.gap_join(inputs.turns(spark, sf_dir), ["rec", "speaker"], 3600.0), "rec", "speaker", "start", "end")


def _union_sql(source: str, name: str, pad: str = "0.0", limit: str | None = None) -> str:
    end = f"e + {pad}" if limit is None else f"least({limit}, e + {pad})"
    return f"""{name}_p AS (SELECT rec, s AS s0, e AS e0, greatest(0.0, s - {pad}) AS s, {end} AS e FROM {source}),
{name}_a AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {name}_p),
{name}_b AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT rec, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY rec, g)"""


@query(sql(f', {_union_sql("turns", "u", "900.0", "2500000.0")} SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM u', "turns"))
def q03_union_pad_limit(spark, sf_dir):
    return _out(spans.union(inputs.turns(spark, sf_dir), REC, 900.0, F.lit(2_500_000.0)), "rec", "start", "end")


_ERRORS = _union_sql("(SELECT rec, s, e FROM turns WHERE speaker = 'error')", "er")
_MEET = """SELECT rec, round(lo, 6) AS start, round(hi, 6) AS "end" FROM
(SELECT segs.rec, greatest(segs.s, er.s) AS lo, least(segs.e, er.e) AS hi FROM segs JOIN er ON segs.rec = er.rec AND segs.s < er.e AND er.s < segs.e) WHERE hi > lo"""


@query(sql(f", {_ERRORS} {_MEET}", "segs"))
def q04_intersect(spark, sf_dir):
    errors = spans.union(_part(spark, sf_dir, "error"), REC)
    return _out(spans.intersect(inputs.segments(spark, sf_dir), errors, REC, WIDTH), "rec", "start", "end")


def _gaps_sql(source: str, name: str) -> str:
    return f"""{name}_r AS (SELECT DISTINCT rec FROM ev), {name}_x AS (SELECT rec, s, e, 0 AS z FROM {source} UNION ALL SELECT rec, {LONG}, NULL, 1 FROM {name}_r),
{name}_l AS (SELECT rec, coalesce(lag(e) OVER (PARTITION BY rec ORDER BY z, s, e), 0.0) AS f, s FROM {name}_x), {name} AS (SELECT rec, f AS s, s AS e FROM {name}_l WHERE s > f)"""


@query(sql(f', {_gaps_sql("segs", "gaps")} SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM gaps', "segs"))
def q05_complement(spark, sf_dir):
    return _out(spans.complement(inputs.segments(spark, sf_dir), inputs.durations(spark, sf_dir), REC), "rec", "start", "end")


@query(sql(f""", {_union_sql("(SELECT rec, s, e FROM turns WHERE speaker IN ('purchase', 'signup'))", "un")}, {_gaps_sql("un", "fr")}
SELECT rec, round(lo, 6) AS start, round(hi, 6) AS "end" FROM (SELECT segs.rec, greatest(segs.s, fr.s) AS lo, least(segs.e, fr.e) AS hi FROM segs JOIN fr ON segs.rec = fr.rec AND segs.s < fr.e AND fr.s < segs.e)
WHERE hi > lo AND hi - lo >= 0.05""", "segs"))
def q06_subtract(spark, sf_dir):
    unsure = _part(spark, sf_dir, "purchase", "signup")
    return _out(spans.subtract(inputs.segments(spark, sf_dir), unsure, inputs.durations(spark, sf_dir), REC, WIDTH), "rec", "start", "end")


@query(sql(""", a AS (SELECT * FROM turns WHERE speaker = 'click'), b AS (SELECT * FROM turns WHERE speaker = 'error')
SELECT a.rec, round(sum(least(a.e, b.e) - greatest(a.s, b.s)), 3) AS overlap FROM a JOIN b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e WHERE least(a.e, b.e) > greatest(a.s, b.s) GROUP BY a.rec""", "turns"))
def q07_overlap_total(spark, sf_dir):
    total = spans.overlap_total(_part(spark, sf_dir, "click"), _part(spark, sf_dir, "error"), REC, WIDTH)
    return total.select("rec", F.round("overlap", 3).alias("overlap"))


@query(sql("""SELECT event_id, rec, round(t, 6) AS t FROM ev WHERE EXISTS (SELECT 1 FROM segs WHERE segs.rec = ev.rec AND ev.t >= segs.s AND ev.t < segs.e)""".join(["\n", ""]), "segs"))
def q08_inside_semi(spark, sf_dir):
    points = inputs.events(spark, sf_dir).select("event_id", "rec", "t")
    return _out(spans.inside(points, inputs.segments(spark, sf_dir), REC, "t", WIDTH), "event_id", "rec", "t")


@query(sql(f""", {_gaps_sql("segs", "snd")}, kp AS (SELECT rec, greatest(0.0, s - 300.0) AS s, least({LONG}, e + 300.0) AS e FROM snd), {_union_sql("kp", "kept")}
SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM kept""", "segs"))
def q09_keep_segments(spark, sf_dir):
    return _out(spans.keep_segments(inputs.segments(spark, sf_dir), inputs.durations(spark, sf_dir), REC, 300.0), "rec", "start", "end")


@query(sql(f""", {_JOIN}, talk AS (SELECT rec, speaker, sum(e - s) AS talk, min(s) AS f FROM joined GROUP BY rec, speaker)
SELECT rec, speaker, round(talk, 3) AS talk, row_number() OVER (PARTITION BY rec ORDER BY talk DESC, f, speaker) - 1 AS rank FROM talk""", "turns"))
def q10_talk_rank(spark, sf_dir):
    ranked = spans.talk_rank(inputs.turns(spark, sf_dir), REC, "speaker", 3600.0)
    return ranked.select("rec", "speaker", F.round("talk", 3).alias("talk"), F.col("rank").cast("long").alias("rank"))


@query(sql('\nSELECT rec, round(s, 6) AS start, round(e, 6) AS "end", round(o, 6) AS "offset" FROM segs', "segs"))
def q11_offsets(spark, sf_dir):
    return _out(timeline.offsets(inputs.segments(spark, sf_dir), REC), "rec", "start", "end", "offset")


@query(sql("""
SELECT event_id, ev.rec, round(CASE WHEN t >= 0 AND t < o + (e - s) THEN s + (t - o) END, 6) AS source_t FROM ev ASOF LEFT JOIN segs ON ev.rec = segs.rec AND ev.t >= segs.o""", "segs"))
def q12_points_to_source(spark, sf_dir):
    points = inputs.events(spark, sf_dir).select("event_id", "rec", "t")
    return _out(timeline.points_to_source(points, inputs.segments(spark, sf_dir), REC), "event_id", "rec", "source_t")


@query(sql("""
SELECT event_id, ev.rec, round(CASE WHEN t >= s AND t < e THEN o + (t - s) END, 6) AS joined_t FROM ev ASOF LEFT JOIN segs ON ev.rec = segs.rec AND ev.t >= segs.s""", "segs"))
def q13_points_from_source(spark, sf_dir):
    points = inputs.events(spark, sf_dir).select("event_id", "rec", "t")
    return _out(timeline.points_from_source(points, inputs.segments(spark, sf_dir), REC), "event_id", "rec", "joined_t")


@query(sql(""", p AS (SELECT event_id, turns.rec, segs.s AS q, greatest(turns.s, segs.o) AS lo, least(turns.e, segs.o + (segs.e - segs.s)) AS hi, segs.o AS o
FROM turns JOIN segs ON turns.rec = segs.rec AND turns.s < segs.o + (segs.e - segs.s) AND segs.o < turns.e WHERE speaker = 'purchase')
SELECT event_id, rec, round(q + (lo - o), 5) AS source_start, round(q + (lo - o) + (hi - lo), 5) AS source_end FROM p WHERE hi > lo""", "segs"))
def q14_to_source(spark, sf_dir):
    asked = inputs.turns(spark, sf_dir).where("speaker = 'purchase'").select("event_id", "rec", "start", "end")
    found = timeline.to_source(asked, inputs.segments(spark, sf_dir), REC, WIDTH)
    return found.select("event_id", "rec", F.round("source_start", 5).alias("source_start"), F.round("source_end", 5).alias("source_end"))


_FROM = """pl AS (SELECT event_id, turns.rec, speaker, turns.s AS ts, turns.e AS te, segs.o + greatest(turns.s, segs.s) - segs.s AS s, segs.o + least(turns.e, segs.e) - segs.s AS e
FROM turns JOIN segs ON turns.rec = segs.rec AND turns.s < segs.e AND segs.s < turns.e WHERE least(turns.e, segs.e) > greatest(turns.s, segs.s))"""


@query(sql(f', {_FROM} SELECT event_id, rec, speaker, round(s, 5) AS start, round(e, 5) AS "end" FROM pl WHERE speaker = \'signup\'', "segs"))
def q15_from_source(spark, sf_dir):
    asked = inputs.turns(spark, sf_dir).where("speaker = 'signup'")
    found = timeline.from_source(asked, inputs.segments(spark, sf_dir), REC, WIDTH)
    return found.select("event_id", "rec", "speaker", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query(sql(f""", {_FROM}, w AS (SELECT *, lag(speaker) OVER o1 AS ls, lag(e) OVER o1 AS le FROM pl WINDOW o1 AS (PARTITION BY rec ORDER BY ts, te, speaker, event_id, s)),
n AS (SELECT *, sum(CASE WHEN ls = speaker AND s - le < 60.0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY ts, te, speaker, event_id, s ROWS UNBOUNDED PRECEDING) AS g FROM w)
SELECT rec, speaker, round(arg_min(s, (ts, te, event_id, s)), 3) AS start, round(arg_max(e, (ts, te, event_id, s)), 3) AS "end" FROM n GROUP BY rec, speaker, g""", "segs"))
def q16_place_merge(spark, sf_dir):
    asked = inputs.turns(spark, sf_dir).withColumns({"turn_start": F.col("start"), "turn_end": F.col("end")})
    placed = timeline.from_source(asked, inputs.segments(spark, sf_dir), REC, WIDTH)
    merged = spans.merge_adjacent(placed, REC, "speaker", ["turn_start", "turn_end", "speaker", "event_id", "start"], 60.0)
    return merged.select("rec", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
