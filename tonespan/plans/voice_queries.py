"""Queries of decoding, vectors, measures, the library and live sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonespan.functions import signal
from tonespan.operators import decode, features, levels, library, measures, spans, vectors
from tonespan.plans import inputs
from tonespan.plans.inputs import LONG, sql
from tonespan.streaming import live

REC = ["rec"]
QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLE_SQL[run.__name__] = oracle
        return run

    return register


def _one(df):
    return df.withColumn("rec", F.lit(0))


@query(sql("\nSELECT frame, k, round(avg(score), 6) AS score FROM sc GROUP BY frame, k", "sc"))
def q33_overlap_add(spark, sf_dir):
    return decode.overlap_add(inputs.scores(spark, sf_dir), []).select("frame", "k", F.round("score", 6).alias("score"))


_COUNT = "cn0 AS (SELECT chunk, frame, count(*) FILTER (WHERE score > 0.09) AS n FROM (SELECT chunk, frame, k, max(score) AS score FROM sc GROUP BY ALL) GROUP BY chunk, frame), cn AS (SELECT frame, CAST(round_even(avg(n), 0) AS INT) AS n FROM cn0 GROUP BY frame)"


def _counts(spark, sf_dir):
    once = inputs.scores(spark, sf_dir).groupBy("chunk", "frame", "k").agg(F.max("score").alias("score"))
    return decode.speaker_count(once.select("chunk", "frame", "k", (F.col("score") > 0.09).alias("on")), [])


@query(sql(f", {_COUNT} SELECT frame, n FROM cn", "sc"))
def q34_speaker_count(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(sql(f""", {_COUNT}, oa AS (SELECT frame, k, round(sum(score), 6) AS score FROM sc GROUP BY frame, k),
rk AS (SELECT oa.frame, k, n, row_number() OVER (PARTITION BY oa.frame ORDER BY score DESC, k) AS p FROM oa JOIN cn ON cn.frame = oa.frame WHERE n > 0) SELECT frame, k FROM rk WHERE p <= n""", "sc"))
def q35_top_count(spark, sf_dir):
    added = decode.overlap_add(inputs.scores(spark, sf_dir), [], average=False).withColumn("score", F.round("score", 6))
    return decode.top_count(added, _counts(spark, sf_dir), [])


@query(sql("""
SELECT frame, k, round(sum(score), 6) AS score FROM (SELECT chunk, frame, k % 2 AS k, max(score) AS score FROM sc GROUP BY chunk, frame, k % 2) GROUP BY frame, k""", "sc"))
def q36_reconstruct_dedup(spark, sf_dir):
    rows = inputs.scores(spark, sf_dir)
    active = rows.select("chunk", "frame", F.col("k").alias("local"), "score")
    clusters = rows.select("chunk", F.col("k").alias("local")).distinct().withColumn("k", F.col("local") % 2)
    return decode.by_cluster(active, clusters, []).select("frame", "k", F.round("score", 6).alias("score"))


_STEP, _DUR = decode.FRAME_STEP, decode.FRAME_DURATION


@query(sql(f""", v AS (SELECT rec, speaker AS k, CAST(floor(t / 7200) AS BIGINT) AS frame, round(least(1.0, sum(value) / 100), 1) AS v FROM (SELECT rec % 8 AS rec, speaker, t, value FROM ev) GROUP BY ALL),
p AS (SELECT rec, k FROM v GROUP BY rec, k HAVING max(v) > 0.5), d AS (SELECT rec, k, frame, coalesce(v, 0.0) AS v FROM (SELECT rec, k, unnest(range(360)) AS frame FROM p) LEFT JOIN v USING (rec, k, frame)),
o AS (SELECT rec, k, frame, last_value(CASE WHEN v > 0.5 THEN 1 WHEN v < 0.5 OR frame = 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec, k ORDER BY frame ROWS UNBOUNDED PRECEDING) AS s FROM d),
g AS (SELECT rec, k, frame, frame - row_number() OVER (PARTITION BY rec, k ORDER BY frame) AS g FROM o WHERE s = 1)
SELECT rec, k, round(min(frame) * {_STEP} + {_DUR} / 2, 6) AS start, round(least(max(frame) + 1, 359) * {_STEP} + {_DUR} / 2, 6) AS "end" FROM g GROUP BY rec, k, g""", "ev"))
def q37_binarize(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).groupBy((F.col("rec") % 8).alias("rec"), F.col("speaker").alias("k"), F.floor(F.col("t") / 7200).alias("frame")).agg(F.round(F.least(F.lit(1.0), F.sum("value") / 100), 1).alias("value"))
    found = decode.binarize(rows, REC, 360)
    return found.select("rec", "k", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_UNIT = "un AS (SELECT vec_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM vp)"


@query(sql(f", {_UNIT} SELECT vec_id, d - 1 AS d, round(u[d], 6) AS x FROM un, (SELECT unnest(range(1, 65)) AS d)", "vp"))
def q38_l2_normalize(spark, sf_dir):
    rows = inputs.voiceprints(spark, sf_dir).select("vec_id", F.posexplode(signal.unit(F.col("vec"))).alias("d", "x"))
    return rows.select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query(sql("\nSELECT speaker, d - 1 AS d, round(avg(vec[d]), 6) AS x FROM vp, (SELECT unnest(range(1, 65)) AS d) GROUP BY speaker, d", "vp"))
def q39_centroids(spark, sf_dir):
    rows = vectors.centroids(inputs.voiceprints(spark, sf_dir), ["speaker"]).select("speaker", F.posexplode("vec").alias("d", "x"))
    return rows.select("speaker", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query(sql(""", ce0 AS (SELECT speaker, d, avg(vec[d]) AS x FROM vp, (SELECT unnest(range(1, 65)) AS d) GROUP BY speaker, d), ce AS (SELECT speaker AS c, list(x ORDER BY d) AS cv FROM ce0 GROUP BY speaker),
l AS (SELECT vec_id, c, round(list_dot_product(vec, cv) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(cv, cv)) + 1e-12), 12) AS s FROM vp, ce)
SELECT vec_id, arg_min(c, (-s, c)) AS speaker, round(max(s), 6) AS likeness FROM l GROUP BY vec_id""", "vp"))
def q40_cosine_assign(spark, sf_dir):
    rows = inputs.voiceprints(spark, sf_dir)
    found = vectors.nearest(rows, vectors.centroids(rows, ["speaker"]))
    return found.select("vec_id", "speaker", F.round("likeness", 6).alias("likeness"))


@query(sql("""
SELECT a.chunk, a.local AS a, b.local AS b, round(list_distance(a.vec, b.vec), 6) AS distance FROM vp a JOIN vp b ON a.chunk = b.chunk AND a.local < b.local WHERE list_distance(a.vec, b.vec) < 1.4""", "vp"))
def q41_pair_distance_under(spark, sf_dir):
    found = vectors.local_distances(inputs.voiceprints(spark, sf_dir), ["chunk"], "local", below=1.4)
    return found.select("chunk", "a", "b", F.round("distance", 6).alias("distance"))


@query(sql(""", tu AS (SELECT rec % 8 AS rec, speaker, t / 3600 AS s, t / 3600 + value / 50 AS e FROM ev), lv2 AS (SELECT rec % 8 AS rec, CAST(floor(t / 3600) AS BIGINT) AS i, 10 * log10(sum(value)) AS db FROM ev GROUP BY ALL),
tk AS (SELECT rec, speaker, sum(e - s) AS talk FROM tu GROUP BY ALL), mn AS (SELECT rec, arg_min(speaker, (-talk, speaker)) AS main FROM tk GROUP BY rec),
ct AS (SELECT DISTINCT rec, speaker, s, e FROM tu WHERE e - s >= 0.3), wd AS (SELECT *, unnest(generate_series(CAST(floor(s) AS BIGINT), CAST(ceil(e) AS BIGINT) - 1)) AS i FROM ct),
pt AS (SELECT wd.rec, speaker, s, e, quantile_cont(db, 0.9) AS p FROM wd JOIN lv2 USING (rec, i) GROUP BY ALL), ld AS (SELECT rec, speaker, quantile_cont(p, 0.5) AS l FROM pt GROUP BY ALL)
SELECT ld.rec, ld.speaker, round(ld.l, 6) AS loudness FROM ld JOIN mn USING (rec) JOIN ld t ON t.rec = ld.rec AND t.speaker = main WHERE ld.speaker <> main AND ld.l <= t.l - 0.05""", "ev"))
def q42_background(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).withColumn("rec", F.col("rec") % 8)
    turns = rows.select("rec", "speaker", (F.col("t") / 3600).alias("start"), (F.col("t") / 3600 + F.col("value") / 50).alias("end"))
    level = rows.groupBy("rec", F.floor(F.col("t") / 3600).alias("i")).agg((10 * F.log10(F.sum("value"))).alias("db"))
    found = levels.background(turns, level, REC, hop=1.0, shortest=0.3, quieter=0.05)
    return found.select("rec", "speaker", F.round("loudness", 6).alias("loudness"))


def _recorded(spark, sf_dir):
    """Voiceprints of recordings of 400."""
    return inputs.voiceprints(spark, sf_dir).withColumn("rec", F.expr("vec_id div 400"))


@query()
def q43_hac_cut(spark, sf_dir):
    return vectors.cluster(_recorded(spark, sf_dir), REC, "vec_id", cut=1.2)


def _voices(spark, sf_dir):
    rows = _recorded(spark, sf_dir)
    talk = rows.groupBy("rec", "speaker").agg((F.count(F.lit(1)) * 0.1).alias("talk"), (F.max("vec_id") % 17 / 10.0).alias("longest"))
    return talk.join(vectors.centroids(rows, ["rec", "speaker"]), ["rec", "speaker"])


@query()
def q44_families(spark, sf_dir):
    return vectors.relabel(_voices(spark, sf_dir), REC, "families")


@query()
def q45_fold_to_n(spark, sf_dir):
    return vectors.relabel(_voices(spark, sf_dir), REC, "fold", 3)


@query()
def q70_speakers_of_known_number(spark, sf_dir):
    return vectors.speakers(_recorded(spark, sf_dir).withColumn("seconds", F.col("vec_id") % 17 / 10.0), REC, "vec_id", n=3, cut=1.2)


_OLD = ",\n".join(f"o{k} AS (SELECT rec, old, z FROM sh WHERE new = {k} UNION ALL SELECT DISTINCT rec, CAST(NULL AS VARCHAR), 0.0 FROM sh)" for k in range(4))
_APART = " AND ".join(f"(o{a}.old IS NULL OR o{b}.old IS NULL OR o{a}.old <> o{b}.old)" for a in range(4) for b in range(a))


@query(sql(f""", sh AS (SELECT x.rec, y.event_id % 4 AS new, x.speaker AS old, sum(least(x.e, y.e) - greatest(x.s, y.s)) AS z FROM turns x JOIN turns y ON x.rec = y.rec AND x.s < y.e AND y.s < x.e GROUP BY ALL),
{_OLD},
cb AS (SELECT o0.rec, [o0.old, o1.old, o2.old, o3.old] AS olds, o0.z + o1.z + o2.z + o3.z AS z FROM o0 JOIN o1 USING (rec) JOIN o2 USING (rec) JOIN o3 USING (rec) WHERE {_APART}),
bs AS (SELECT rec, arg_max(olds, z) AS olds FROM cb GROUP BY rec)
SELECT rec, new, old FROM (SELECT rec, unnest(range(4)) AS new, unnest(olds) AS old FROM bs) WHERE old IS NOT NULL""", "turns"))
def q46_stable_ids(spark, sf_dir):
    old = inputs.turns(spark, sf_dir).select("rec", F.col("speaker").alias("old"), "start", "end")
    new = inputs.turns(spark, sf_dir).select("rec", (F.col("event_id") % 4).alias("new"), "start", "end")
    shared = spans.overlap_pairs(old, new, REC, 20_000.0).groupBy("rec", "new", "old").agg(F.sum(F.col("high") - F.col("low")).alias("seconds"))
    return vectors.stable_ids(shared, REC)


_RULES = """f0 AS (SELECT *, CASE WHEN semitones <> 0 AND 27.5 * pow(2, semitones / 12) BETWEEN 50 AND 500 THEN 27.5 * pow(2, semitones / 12) END AS f FROM fr),
ru AS (SELECT event_id, rec, src, t, loudness, hnr, CASE WHEN hnr > 0 THEN f END AS f0, CASE WHEN hnr > 0 AND f IS NOT NULL THEN f1 END AS f1, CASE WHEN hnr > 0 AND f IS NOT NULL THEN f2 END AS f2, CASE WHEN hnr > 0 AND f IS NOT NULL THEN f3 END AS f3 FROM f0)"""


def _ruled(spark, sf_dir):
    return measures.rules(inputs.frames(spark, sf_dir), gate=True)


@query(sql(f", {_RULES} SELECT event_id, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3 FROM ru", "fr"))
def q47_rules(spark, sf_dir):
    return _ruled(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(c) for c in ("f0", "f1", "f2", "f3")])


@query(sql(f""", {_RULES}, n AS (SELECT rec, f0, row_number() OVER (PARTITION BY rec ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM ru)
SELECT rec, bin, round(quantile_cont(f0, 0.5), 6) AS f0 FROM (SELECT rec, f0, CASE WHEN n <= 50 THEN i ELSE ((i + 1) * 50 - 1) // n END AS bin FROM n) GROUP BY rec, bin""", "fr"))
def q48_bin_equal(spark, sf_dir):
    rows = _ruled(spark, sf_dir).withColumn("_order", F.struct("t", "event_id"))
    return measures.bin_equal(rows, REC, "_order", "f0", 50).select("rec", "bin", F.round("value", 6).alias("f0"))


@query(sql(f""", {_RULES} SELECT rec, CAST(least(99, greatest(0, floor(t / 2592000.0 * 100))) AS INT) AS bin, round(quantile_cont(f0, 0.5), 6) AS f0 FROM ru WHERE f0 IS NOT NULL GROUP BY rec, least(99, greatest(0, floor(t / 2592000.0 * 100)))""", "fr"))
def q49_bin_time(spark, sf_dir):
    return measures.bin_time(_ruled(spark, sf_dir), REC, "t", "f0", F.lit(2_592_000.0), 100).select("rec", "bin", F.round("value", 6).alias("f0"))


@query(sql(f""", {_RULES} SELECT rec, round(quantile_cont(f0, 0.5), 6) AS median, round(quantile_cont(f0, 0.1), 6) AS p10, round(quantile_cont(f0, 0.9), 6) AS p90, round(100 * count(f0) / count(*), 6) AS voiced, round(quantile_cont(hnr, 0.5), 6) AS hnr FROM ru GROUP BY rec""", "fr"))
def q50_summary(spark, sf_dir):
    return measures.summary(_ruled(spark, sf_dir), REC).select("rec", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90", "voiced", "hnr")])


@query(sql(f', {_RULES} SELECT rec, round(100 * avg((f0 < 60)::INT), 6) AS below, round(100 * avg((f0 > 200)::INT), 6) AS above FROM ru WHERE f0 IS NOT NULL GROUP BY rec', "fr"))
def q51_guide_stats(spark, sf_dir):
    return measures.guide_shares(_ruled(spark, sf_dir), REC, 60, 200).select("rec", F.round("below", 6).alias("below"), F.round("above", 6).alias("above"))


@query(sql(f""", {_RULES}, o AS (SELECT rec, list(f0 ORDER BY f0) AS v FROM ru WHERE f0 IS NOT NULL GROUP BY rec)
SELECT rec, round(v[1 + least(CAST(floor(0.05 * len(v)) AS BIGINT), len(v) - 1)], 6) AS low, round(v[1 + least(CAST(floor(0.95 * len(v)) AS BIGINT), len(v) - 1)], 6) AS high FROM o""", "fr"))
def q52_index_quantiles(spark, sf_dir):
    found = measures.index_quantiles(_ruled(spark, sf_dir), REC, "f0", {"low": 0.05, "high": 0.95})
    return found.select("rec", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_USABLE = f"""{_RULES}, us AS (SELECT rec, t, (ln(f1) + ln(f2) + ln(f3)) / 3 AS level, ln(f2) - ln(f1) AS s1, f0 FROM ru
WHERE f0 > 40 AND f1 BETWEEN 150 AND 1200 AND f2 BETWEEN 500 AND 3500 AND f3 BETWEEN 1200 AND 5000 AND f1 < f2 AND f2 < f3)"""
_DAY = 86_400.0


@query(sql(f", {_USABLE} SELECT rec, round(t, 6) AS t, round(level - avg(level) OVER w, 9) AS d_level, round(s1 - avg(s1) OVER w, 9) AS d_s1 FROM us WINDOW w AS (PARTITION BY rec, floor(t / {_DAY}))", "fr"))
def q53_within_stretch_residual(spark, sf_dir):
    rows = measures.within_stretch(measures.usable(_ruled(spark, sf_dir), REC), REC, ["level", "s1"], _DAY)
    return rows.select("rec", F.round("t", 6).alias("t"), F.round("d_level", 9).alias("d_level"), F.round("d_s1", 9).alias("d_s1"))


@query()
def q54_trend(spark, sf_dir):
    rows = measures.usable(_ruled(spark, sf_dir), REC)
    left = measures.residuals(rows, REC, measures.fit(rows, REC, stretch=_DAY))
    found = measures.trend(left, REC, 2_592_000.0, 3600.0, step=3600.0, window=8 * _DAY, near=_DAY / 4, enough=_DAY)
    return found.select("rec", "t", F.round("pct", 4).alias("pct"), F.round("conf", 6).alias("conf"))


@query(sql(f""", {_USABLE}, re AS (SELECT rec, t, level - avg(level) OVER (PARTITION BY rec) AS r FROM us), bl AS (SELECT rec, floor(t / {_DAY}) AS b, sum(r) AS s, count(*) AS n, sum(r) / count(*) AS m FROM re GROUP BY rec, floor(t / {_DAY})),
pr AS (SELECT rec, b, count(*) OVER p AS ak, sum(s) OVER p AS asu, sum(n) OVER p AS an, sum(m) OVER p AS am, sum(m * m) OVER p AS aq, count(*) OVER w AS wk, sum(s) OVER w AS ws, sum(n) OVER w AS wn, sum(m) OVER w AS wm, sum(m * m) OVER w AS wq
FROM bl WINDOW p AS (PARTITION BY rec ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY rec)),
sd AS (SELECT rec, b, asu / an AS ma, (aq - 2 * asu / an * am + ak * pow(asu / an, 2)) / greatest(1, ak - 1) / ak AS va, (ws - asu) / (wn - an) AS mb,
(wq - aq - 2 * (ws - asu) / (wn - an) * (wm - am) + (wk - ak) * pow((ws - asu) / (wn - an), 2)) / greatest(1, wk - ak - 1) / (wk - ak) AS vb FROM pr WHERE wk >= 8 AND ak >= 2 AND wk - ak > 2 AND an * 3600 >= 20 AND (wn - an) * 3600 >= 20),
zs AS (SELECT rec, b * {_DAY} AS a_t, 100 * (exp(mb - ma) - 1) AS pct, (mb - ma) / sqrt(abs(va + vb) + 1e-12) AS z FROM sd), be AS (SELECT rec, arg_min({{'a_t': a_t, 'pct': pct, 'z': z}}, (-round(abs(z), 9), a_t)) AS x FROM zs GROUP BY rec)
SELECT rec, x.a_t AS "at", round(x.pct, 5) AS pct, round(x.z, 5) AS z, abs(x.pct) >= 2 AND abs(x.z) >= 3 AS change FROM be""", "fr"))
def q55_change_point(spark, sf_dir):
    rows = measures.usable(_ruled(spark, sf_dir), REC)
    plain = measures.within_stretch(rows, REC, ["level"], 1e12).withColumn("r", F.col("d_level"))
    found = measures.change_point(plain, REC, 3600.0, _DAY)
    return found.select("rec", "at", F.round("pct", 5).alias("pct"), F.round("z", 5).alias("z"), "change")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def q56_content_dedup(spark, sf_dir):
    return library.content_groups(inputs.table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT conv_id AS rec, count(DISTINCT role) AS speakers, count(*) AS turns, round(sum(length(text) / 15.0), 6) AS talk FROM conversations GROUP BY conv_id")
def q57_entries(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), F.col("role").alias("speaker"), F.lit(0.0).alias("start"), (F.length("text") / 15.0).alias("end"))
    return library.entries(rows, REC).withColumn("talk", F.round("talk", 6))


@query(sql(""", an AS (SELECT rec, 'name ' || event_id % 4 AS name, s, e FROM turns WHERE event_id % 9 = 0),
sc AS (SELECT an.rec, an.name, tu.speaker, sum(least(an.e, tu.e) - greatest(an.s, tu.s)) AS z FROM an JOIN turns tu ON tu.rec = an.rec AND an.s < tu.e AND tu.s < an.e GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY z DESC, name DESC, speaker DESC) AS p FROM sc WHERE z > 0),
st AS (SELECT DISTINCT rec, CAST(0 AS BIGINT) AS p, CAST([] AS VARCHAR[]) AS ns, CAST([] AS VARCHAR[]) AS ss FROM rk
UNION ALL SELECT st.rec, rk.p, CASE WHEN list_contains(ns, name) OR list_contains(ss, speaker) THEN ns ELSE list_append(ns, name) END, CASE WHEN list_contains(ns, name) OR list_contains(ss, speaker) THEN ss ELSE list_append(ss, speaker) END FROM st JOIN rk ON rk.rec = st.rec AND rk.p = st.p + 1),
ls AS (SELECT rec, arg_max(ns, p) AS ns, arg_max(ss, p) AS ss FROM st GROUP BY rec)
SELECT rec, unnest(ss) AS speaker, unnest(ns) AS name FROM ls""", "turns").replace("WITH ", "WITH RECURSIVE ", 1))
def q58_names_from_anchors(spark, sf_dir):
    turns = inputs.turns(spark, sf_dir).withColumnRenamed("event_id", "id")
    anchors = turns.where("id % 9 = 0").select("rec", F.concat(F.lit("name "), (F.col("id") % 4).cast("string")).alias("name"), "start", "end")
    return library.names_from_anchors(library.anchor_scores(anchors, turns, REC, 20_000.0), REC)


_SPEECH = """sp AS (SELECT rec, s AS s0, e AS e0, greatest(0.0, s - 60.0) AS s, least(2592000.0, e + 60.0) AS e FROM turns WHERE speaker = 'signup'),
sp1 AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp), sp2 AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS g FROM sp1),
sp3 AS (SELECT rec, min(s) AS s, max(e) AS e FROM sp2 GROUP BY rec, g)"""


@query(sql(f', {_SPEECH} SELECT segs.rec, round(greatest(segs.s, sp3.s), 6) AS start, round(least(segs.e, sp3.e), 6) AS "end" FROM segs JOIN sp3 ON segs.rec = sp3.rec AND segs.s < sp3.e AND sp3.s < segs.e', "segs"))
def q59_speech_only_segments(spark, sf_dir):
    turns = inputs.turns(spark, sf_dir).where("speaker = 'signup'").select("rec", "start", "end")
    found = library.speech_segments(inputs.segments(spark, sf_dir), turns, REC, 60.0, F.lit(2_592_000.0), 20_000.0)
    return found.select("rec", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(sql("\nSELECT event_id, round(t, 6) AS t FROM ev ORDER BY coalesce(t, 0) DESC, event_id LIMIT 50", "ev"))
def q60_newest_first(spark, sf_dir):
    """The newest entries: the limit is the feature."""
    return library.newest(inputs.events(spark, sf_dir).select("event_id", "t"), "t", "event_id", 50).select("event_id", F.round("t", 6).alias("t"))


@query("""SELECT l_orderkey, l_linenumber, [l_linenumber IN (2, 5, 6), l_linenumber IN (3, 5, 7), l_linenumber IN (4, 6, 7)] AS active FROM lineitem""")
def q61_powerset(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", features.powerset(F.col("l_linenumber") - 1).alias("active"))


_LABELS = """lt AS (SELECT rec, speaker, t AS s, t + value * 60 AS e FROM ev),
lf AS (SELECT rec, frame, arg_max(speaker, (s, e, speaker)) AS speaker FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((s - 600.0) / 1200.0) AS BIGINT)), greatest(0, CAST(ceil((e - 600.0) / 1200.0) AS BIGINT)))) AS frame FROM lt) GROUP BY rec, frame)"""


def _labelled(spark, sf_dir):
    turns = inputs.events(spark, sf_dir).select("rec", "speaker", F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"))
    return decode.label_frames(turns, REC, 1200.0, 1200.0)


@query(sql(f", {_LABELS} SELECT rec, frame, speaker FROM lf", "ev"))
def q62_label_frames(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(sql(f""", {_LABELS}, ac AS (SELECT rec, frame // 72 AS chunk, frame % 3 AS local, frame FROM lf), hi AS (SELECT rec, chunk, local, speaker, count(*) AS n FROM ac JOIN lf USING (rec, frame) GROUP BY ALL)
SELECT rec, chunk, local, arg_min(speaker, (-n, speaker)) AS speaker, max(n) AS frames FROM hi GROUP BY rec, chunk, local""", "ev"))
def q63_window_speaker(spark, sf_dir):
    labels = _labelled(spark, sf_dir)
    active = labels.select("rec", F.expr("frame div 72").alias("chunk"), (F.col("frame") % 3).alias("local"), "frame")
    return decode.window_speakers(active, labels, REC)


@query(sql(""", an AS (SELECT rec, 'name ' || event_id % 3 AS name, s, e FROM turns WHERE event_id % 7 = 0), mi AS (SELECT * FROM turns WHERE speaker = 'click'),
cv AS (SELECT an.rec, an.name, sum(least(an.e, mi.e) - greatest(an.s, mi.s)) AS m FROM an JOIN mi ON an.rec = mi.rec AND an.s < mi.e AND mi.s < an.e GROUP BY ALL),
sz AS (SELECT rec, name, sum(e - s) AS z FROM an GROUP BY ALL), go AS (SELECT rec, name FROM cv JOIN sz USING (rec, name) WHERE m > 0.5 * z)
SELECT rec, name, round(s, 6) AS start, round(e, 6) AS "end" FROM an WHERE (rec, name) NOT IN (SELECT rec, name FROM go) UNION ALL SELECT rec, 'Anna', round(s, 6), round(e, 6) FROM mi""", "turns"))
def q64_rename_anchors(spark, sf_dir):
    turns = inputs.turns(spark, sf_dir)
    anchors = turns.where("event_id % 7 = 0").select("rec", F.concat(F.lit("name "), (F.col("event_id") % 3).cast("string")).alias("name"), "start", "end")
    names = turns.select("rec").distinct().select("rec", F.lit("click").alias("speaker"), F.lit(" Anna ").alias("name"))
    found = library.rename(anchors, turns.select("rec", "speaker", "start", "end"), names, REC, 20_000.0)
    return found.select("rec", "name", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_MEL = f"1127 * ln(1 + {features.RATE / 2} / 700.0)"
_LOW = f"1127 * ln(1 + {features.LOWEST_HZ} / 700.0)"


@query(sql(f""", sr AS (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, CAST(l_extendedprice AS DOUBLE) / 200000 AS x FROM lineitem),
nf AS (SELECT rec, unnest(range(0, (max(i) + 1 - 400) // 160 + 1)) AS frame FROM sr GROUP BY rec HAVING max(i) + 1 >= 400),
fr0 AS (SELECT nf.rec, nf.frame, sr.i - nf.frame * 160 AS j, x * 32768 - avg(x * 32768) OVER (PARTITION BY nf.rec, nf.frame) AS x FROM nf JOIN sr ON sr.rec = nf.rec AND sr.i >= nf.frame * 160 AND sr.i < nf.frame * 160 + 400),
fr1 AS (SELECT rec, frame, j, (x - 0.97 * coalesce(lag(x) OVER (PARTITION BY rec, frame ORDER BY j), x)) * (0.54 - 0.46 * cos(2 * pi() * j / 399)) AS y FROM fr0),
po AS (SELECT rec, frame, k, pow(sum(y * cos(2 * pi() * j * k / 512)), 2) + pow(sum(y * sin(2 * pi() * j * k / 512)), 2) AS p FROM fr1 CROSS JOIN (SELECT unnest(range(256)) AS k) f GROUP BY rec, frame, k),
ed AS (SELECT unnest(range(82)) AS e), eg AS (SELECT e, {_LOW} + e * ({_MEL} - {_LOW}) / 81 AS m FROM ed),
tr AS (SELECT b.e - 1 AS mel, k, greatest(0, least((1127 * ln(1 + k * {features.RATE} / 512.0 / 700) - a.m) / (b.m - a.m), (c.m - 1127 * ln(1 + k * {features.RATE} / 512.0 / 700)) / (c.m - b.m))) AS w FROM eg a JOIN eg b ON b.e = a.e + 1 JOIN eg c ON c.e = a.e + 2 CROSS JOIN (SELECT unnest(range(256)) AS k) f),
lm AS (SELECT rec, frame, mel, ln(greatest(sum(p * w), 1.1920928955078125e-07)) AS v FROM po JOIN tr USING (k) WHERE w > 0 OR k = 0 GROUP BY rec, frame, mel)
SELECT rec, CAST(frame AS INT) AS frame, CAST(mel AS INT) AS mel, round(v - avg(v) OVER (PARTITION BY rec, mel), 6) AS value FROM lm"""))
def q65_log_mel(spark, sf_dir):
    """Features of a supplier's prices as a series of samples."""
    rows = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rec")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))).alias("x"))
    series = rows.select("rec", F.transform("x", lambda r: r["l_extendedprice"].cast("double") / 200_000).alias("pcm"))
    mels = features.log_mel_rows(series, ["rec"])
    return mels.select("rec", "frame", F.posexplode("mels").alias("mel", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT user_id AS rec, count(*) AS blocks, max(abs(value - 20)) AS peak, count(*) FILTER (WHERE abs(value - 20) > 0) AS sound, count(*) FILTER (WHERE abs(value - 20) = 0) AS zeros FROM events GROUP BY user_id""")
def q66_input_stats(spark, sf_dir):
    return live.input_stats(inputs.events(spark, sf_dir).select("rec", (F.col("value") - 20).alias("v")), REC, "v")


@query(sql(""", si AS (SELECT rec % 8 AS room, rec, min(t) AS fi, max(t) AS la, max(CASE WHEN value > 20 THEN t END) AS so FROM ev GROUP BY ALL), sn AS (SELECT *, max(la) OVER (PARTITION BY room) AS n FROM si)
SELECT room, rec, CASE WHEN n - la >= 86400 THEN 'none' ELSE 'zeros' END AS kind, CAST(floor(CASE WHEN n - la >= 86400 THEN n - la ELSE n - coalesce(so, fi) END + 0.5) AS BIGINT) AS seconds FROM sn WHERE n - la >= 86400 OR n - coalesce(so, fi) >= 86400""", "ev"))
def q71_silent_inputs(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).select((F.col("rec") % 8).alias("room"), "rec", "t", F.greatest(F.col("value") - 20, F.lit(0.0)).alias("v"))
    return live.silent_inputs(rows, ["room"], "rec", "t", "v", after=86_400.0)


@query(sql(""", bl AS (SELECT rec, t AS a, value * 100 AS n FROM ev), pl AS (SELECT *, max(a + n) OVER (PARTITION BY rec ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS re FROM bl),
p2 AS (SELECT *, coalesce(CASE WHEN a - re <= 60 THEN greatest(re, a - 60) ELSE a END, a) AS s FROM pl)
SELECT rec, round(a, 6) AS "at", round(s, 6) AS start, round(greatest(s, a + n), 6) AS "end", round(greatest(0.0, least(n, coalesce(re - a, 0.0))), 6) AS trimmed, coalesce(a + n <= re, false) AS late FROM p2""", "ev"))
def s01_placement(spark, sf_dir):
    blocks = inputs.events(spark, sf_dir).select("rec", F.col("t").alias("at"), (F.col("value") * 100).alias("length"))
    placed = live.place(blocks, REC, snap=60.0)
    return placed.select("rec", *[F.round(c, 6).alias(c) for c in ("at", "start", "end", "trimmed")], "late")


@query(sql(""", b AS (SELECT rec, CAST(floor(t / 3600) AS BIGINT) AS block, sum(value) AS v FROM ev GROUP BY ALL), x AS (SELECT rec, unnest(generate_series(min(block), max(block))) AS block FROM b GROUP BY rec)
SELECT x.rec, x.block, round(coalesce(v, 0.0), 6) AS value, v IS NULL AS padded FROM x LEFT JOIN b ON b.rec = x.rec AND b.block = x.block""", "ev"))
def s02_gap_fill(spark, sf_dir):
    blocks = inputs.events(spark, sf_dir).groupBy("rec", F.floor(F.col("t") / 3600).alias("block")).agg(F.sum("value").alias("value"))
    return live.fill_gaps(blocks, REC, "block", "value").select("rec", "block", F.round("value", 6).alias("value"), "padded")


@query(sql("""
SELECT rec, (h - k) * 3600 AS start, round(sum(value), 6) AS total, count(*) AS n FROM (SELECT rec, value, CAST(floor(t / 3600) AS BIGINT) AS h FROM ev), (SELECT unnest(range(10)) AS k) GROUP BY ALL""", "ev"))
def s03_sliding_windows(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).select("rec", "value", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    found = live.windows(rows, REC, "ts", "10 hours", "1 hour", F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return found.select("rec", F.unix_seconds("window.start").alias("start"), F.round("total", 6).alias("total"), "n")


@query()
def s04_provisional_labels(spark, sf_dir):
    return live.label_online(_recorded(spark, sf_dir).where("vec is not null"), REC, "vec_id", distance=1.2)


@query()
def s05_regrouped_labels(spark, sf_dir):
    """Batch form: labels of the whole, and online ones past it."""
    rows = _recorded(spark, sf_dir)
    whole = vectors.cluster(rows.where("vec_id % 400 < 300"), REC, "vec_id", cut=1.2).select("rec", F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("end"), F.col("cluster").alias("speaker"))
    online = live.label_online(rows, REC, "vec_id", distance=1.2).select("rec", F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("end"), "speaker")
    return live.merge_labels(whole, online, F.col("rec") * 400 + 300)


@query(sql(""", tr AS (SELECT rec, speaker, CAST(floor(s / 432000) AS BIGINT) AS round, s, e - s AS n FROM turns),
vo AS (SELECT rec, round, speaker, sum(n) / 50000 AS talk, max(n) / 50000 AS longest, min(s) AS first, speaker = 'view' AS own FROM tr GROUP BY ALL),
ri AS (SELECT rec, round, row_number() OVER (PARTITION BY rec ORDER BY round) AS i FROM (SELECT DISTINCT rec, round FROM vo)), vi AS (SELECT vo.*, ri.i FROM vo JOIN ri USING (rec, round)),
st AS (SELECT rec, CAST(0 AS BIGINT) AS i, speaker, CAST(0 AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS nxt FROM (SELECT DISTINCT rec, speaker FROM vo)
UNION ALL SELECT rec, i, speaker, seen, CASE WHEN new THEN nxt + row_number() OVER (PARTITION BY rec, new ORDER BY first, speaker) - 1 ELSE ord END, nxt + count(*) FILTER (WHERE new) OVER (PARTITION BY rec)
FROM (SELECT *, cand AND (own OR seen >= 2 OR (NOT anyone AND row_number() OVER (PARTITION BY rec, cand ORDER BY first, speaker) = 1)) AS new
FROM (SELECT *, coalesce(bool_or(present AND ord IS NOT NULL) OVER (PARTITION BY rec), false) AS anyone, present AND ord IS NULL AND talk >= 2 AND longest >= 0.8 AS cand
FROM (SELECT st.rec, ri.i, st.speaker, CASE WHEN v.speaker IS NULL THEN 0 ELSE st.seen + 1 END AS seen, st.ord, st.nxt, v.talk, v.longest, v.first, v.own, v.speaker IS NOT NULL AS present
FROM st JOIN ri ON ri.rec = st.rec AND ri.i = st.i + 1 LEFT JOIN vi v ON v.rec = st.rec AND v.i = ri.i AND v.speaker = st.speaker))))
SELECT rec, speaker, CAST(max(ord) AS INT) AS "order" FROM st WHERE ord IS NOT NULL GROUP BY rec, speaker""", "turns").replace("WITH ", "WITH RECURSIVE ", 1))
def s06_confirmation(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir).withColumn("round", F.floor(F.col("start") / 432_000))
    stats = rows.groupBy("rec", "round", "speaker").agg((F.sum(F.col("end") - F.col("start")) / 50_000).alias("talk"), (F.max(F.col("end") - F.col("start")) / 50_000).alias("longest"), F.min("start").alias("first"))
    return live.confirm(stats.withColumn("own", F.col("speaker") == "view"), REC)


@query(sql(""", o AS (SELECT rec, t, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)), g AS (SELECT rec, t, sum(n) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT rec, round(min(t), 6) AS first, count(*) AS n FROM g GROUP BY rec, g""", "ev"))
def s07_session_windows(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).select("rec", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    found = live.sessions(rows, REC, "ts", "6 hours", F.min("t").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.select("rec", F.round("first", 6).alias("first"), "n")


@query(sql(""", df AS (SELECT rec, i, value FROM lv WHERE kind <> 'error'), nn AS (SELECT rec, max(i) + 1 AS n FROM lv GROUP BY rec),
vw AS (SELECT rec, n, greatest(0, CAST(floor(20.0 / 100 * n) AS BIGINT)) AS a, least(n, CAST(ceil(70.0 / 100 * n) AS BIGINT)) AS b FROM nn),
vk AS (SELECT *, greatest(1, CAST(ceil((b - a) / 90) AS BIGINT)) AS k FROM vw), bk AS (SELECT rec, n, a, b, k, unnest(range(0, CAST(ceil((b - a) / k) AS BIGINT))) AS bucket FROM vk)
SELECT bk.rec, CAST(bk.bucket AS INT) AS bucket, round((a + bucket * k + (least(a + (bucket + 1) * k, b) - a - bucket * k) / 2) / any_value(n) * 100, 6) AS t, round(avg(value), 6) AS mean
FROM bk LEFT JOIN df ON df.rec = bk.rec AND df.i >= a + bucket * k AND df.i < least(a + (bucket + 1) * k, b) GROUP BY bk.rec, bk.bucket, a, b, k""", "lv"))
def q74_visible_means(spark, sf_dir):
    rows = inputs.levels(spark, sf_dir).select("rec", "i", F.when(F.col("kind") != "error", F.col("value")).alias("value"))
    found = measures.visible_means(rows, REC, "i", "value", 20.0, 70.0, 100.0, 90)
    return found.select("rec", "bucket", F.round("t", 6).alias("t"), F.round("mean", 6).alias("mean"))
