"""Queries of live sessions: aligned inputs, labels that hold, halo blocks, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonespan.operators import diarize, features, halo, vectors
from tonespan.operators.lineage import cut
from tonespan.plans import inputs
from tonespan.plans.inputs import sql
from tonespan.streaming import aligned, confirm, live, overlay

REC = ["rec"]
QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLE_SQL[run.__name__] = oracle
        return run

    return register


# aligned inputs: a session of ten users, three inputs, eight samples a block

CLOCK = aligned.Clock(rate=160)
_CHUNKS = """
, ch0 AS (SELECT user_id // 10 AS rec, CAST(event_id % 3 AS INT) AS src, event_id, event_type, row_number() OVER (PARTITION BY user_id // 10, event_id % 3 ORDER BY ts, event_id) - 1 AS j FROM events),
ch1 AS (SELECT rec, src, greatest(j * 8 + event_id % 5 - 2, 0) AS a, 8 + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS n, event_id % 7 + 1 AS v,
j * 8 + 12 + (event_id * 7919) % 40 + CASE WHEN event_id % 23 = 0 THEN 1000 ELSE 0 END AS arr FROM ch0 WHERE event_type <> 'error'),
ch AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY arr, src, a) AS k FROM ch1),
st AS (SELECT rec, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS h0, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, CAST(0 AS BIGINT) AS w, 0 AS src, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS arr, false AS late FROM (SELECT DISTINCT rec FROM ch)
UNION ALL SELECT rec, k, h0, h1, h2, greatest(w1, least(greatest(h0 // 8 * 8, hold), greatest(h1 // 8 * 8, hold), greatest(h2 // 8 * 8, hold))) AS w, src, s, cut, n, v, arr, late
FROM (SELECT rec, k, CASE WHEN src = 0 AND n > cut THEN s + n - cut ELSE h0 END AS h0, CASE WHEN src = 1 AND n > cut THEN s + n - cut ELSE h1 END AS h1, CASE WHEN src = 2 AND n > cut THEN s + n - cut ELSE h2 END AS h2, w1, hold, src, s, cut, n, v, arr, late
FROM (SELECT *, greatest(0, least(n, base - s0)) AS cut, CASE WHEN base > s0 THEN base ELSE s0 END AS s, w1 > h AS late
FROM (SELECT *, CASE WHEN abs(a - base) <= 3 THEN base ELSE a END AS s0
FROM (SELECT *, greatest(h, w1) AS base
FROM (SELECT st.rec, c.k, c.src, c.a, c.n, c.v, c.arr, st.h0, st.h1, st.h2, CASE c.src WHEN 0 THEN st.h0 WHEN 1 THEN st.h1 ELSE st.h2 END AS h, greatest(c.arr - 800, 0) // 8 * 8 AS hold,
greatest(st.w, least(greatest(st.h0 // 8 * 8, greatest(c.arr - 800, 0) // 8 * 8), greatest(st.h1 // 8 * 8, greatest(c.arr - 800, 0) // 8 * 8), greatest(st.h2 // 8 * 8, greatest(c.arr - 800, 0) // 8 * 8))) AS w1
FROM st JOIN ch c ON c.rec = st.rec AND c.k = st.k + 1)))))),
fin AS (SELECT rec, max(greatest(h0, h1, h2, w)) AS e, max(w) AS w, max(arr) AS last FROM st GROUP BY rec),
bl AS (SELECT rec, w, last, e, unnest(range(0, (e + 7) // 8)) AS b FROM fin),
fr AS (SELECT rec, src, f, f // 8 AS b, v + i AS x FROM (SELECT rec, src, v, i, s + i - cut AS f FROM (SELECT rec, src, v, s, cut, unnest(range(cut, n)) AS i FROM st WHERE k > 0)))"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def chunks(spark, sf_dir):
    """Pieces of sound: some missing, some longer than a block, out of place by up to two
    samples, delayed, a few beyond the longest wait."""
    e = inputs.table(spark, sf_dir, "events").select(F.expr("user_id div 10").alias("rec"), (F.col("event_id") % 3).cast("int").alias("source"), "event_id", "event_type", "ts")
    j = F.row_number().over(Window.partitionBy("rec", "source").orderBy("ts", "event_id")) - 1
    k = F.col("event_id")
    n = F.lit(8) + F.when(k % 11 == 0, 4).otherwise(0)
    pcm = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + k % 7 + 1).cast("double"))
    arrived = F.col("j") * 8 + 12 + (k * 7919) % 40 + F.when(k % 23 == 0, 1000).otherwise(0)
    return e.withColumn("j", j).where("event_type <> 'error'").select("rec", F.lit(3).alias("inputs"), "source", F.greatest(F.col("j") * 8 + k % 5 - 2, F.lit(0)).cast("long").alias("at"), pcm.alias("pcm"), arrived.cast("long").alias("arrived"))


@query(_recursive(sql(_CHUNKS, "ev")) + """,
ti AS (SELECT bl.rec, bl.b, min(CASE WHEN st.h0 >= (bl.b + 1) * 8 THEN st.arr END) AS t0, min(CASE WHEN st.h1 >= (bl.b + 1) * 8 THEN st.arr END) AS t1, min(CASE WHEN st.h2 >= (bl.b + 1) * 8 THEN st.arr END) AS t2 FROM bl JOIN st ON st.rec = bl.rec GROUP BY bl.rec, bl.b),
du AS (SELECT rec, b, max(greatest(least(coalesce(t0, 1000000000), (b + 1) * 8 + 800), least(coalesce(t1, 1000000000), (b + 1) * 8 + 800), least(coalesce(t2, 1000000000), (b + 1) * 8 + 800))) OVER (PARTITION BY rec ORDER BY b) AS d FROM ti),
mx AS (SELECT rec, b, sum(m) AS total, sum(m * m) AS energy, sum(c) AS c FROM (SELECT rec, b, f, sum(x) AS m, count(*) AS c FROM fr GROUP BY rec, b, f) GROUP BY rec, b)
SELECT bl.rec, bl.b AS block, CASE WHEN bl.b < bl.w // 8 THEN du.d ELSE bl.last END AS due, CAST(least(8, bl.e - bl.b * 8) AS INT) AS frames, CAST(coalesce(mx.total, 0) AS DOUBLE) AS total, CAST(coalesce(mx.energy, 0) AS DOUBLE) AS energy, CAST(3 * least(8, bl.e - bl.b * 8) - coalesce(mx.c, 0) AS BIGINT) AS padded
FROM bl JOIN du ON du.rec = bl.rec AND du.b = bl.b LEFT JOIN mx ON mx.rec = bl.rec AND mx.b = bl.b""")
def s08_aligned_blocks(spark, sf_dir):
    found = aligned.align(chunks(spark, sf_dir), "rec", CLOCK)

    def total(f):
        return F.aggregate("mix", F.lit(0.0), lambda a, x: a + f(x))

    padded = F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("rec", "block", "due", "frames", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("energy"), padded.alias("padded"))


@query(_recursive(sql(_CHUNKS, "ev")) + """
SELECT fin.rec, i.src AS source, count(st.k) AS chunks, coalesce(sum(st.n), 0)::BIGINT AS sound, CAST(0 AS BIGINT) AS zeros, CAST(any_value(fin.e) - coalesce(sum(st.n - st.cut), 0) AS BIGINT) AS padded,
coalesce(sum(st.cut) FILTER (WHERE NOT st.late), 0)::BIGINT AS trimmed, coalesce(sum(st.cut) FILTER (WHERE st.late), 0)::BIGINT AS late, CAST(max(st.v + st.n - 1) AS DOUBLE) AS peak
FROM fin CROSS JOIN (SELECT unnest([0, 1, 2]) AS src) i LEFT JOIN st ON st.rec = fin.rec AND st.src = i.src AND st.k > 0 GROUP BY fin.rec, i.src""")
def s09_input_counters(spark, sf_dir):
    return aligned.counters(chunks(spark, sf_dir), "rec", CLOCK).select("rec", "source", "chunks", "sound", "zeros", "padded", "trimmed", "late", "peak")


# labels that hold: regrouped up to a moment of each recording, online labels past it

_HELD = """, un AS (SELECT DISTINCT rec, 1000000.0 + rec % 7 * 100000 AS u FROM ev),
gr AS (SELECT turns.rec, s, least(e, u) AS e, speaker FROM turns JOIN un USING (rec) WHERE speaker IN ('click', 'view') AND s < u),
ow AS (SELECT turns.rec, s, e, speaker FROM turns WHERE speaker = 'purchase' AND rec % 3 = 0),
oc AS (SELECT turns.rec, s, e, speaker FROM turns WHERE speaker <> 'error' AND NOT (speaker = 'purchase' AND rec % 3 = 0)),
held AS (SELECT rec, s, e, speaker, 0 AS g FROM gr UNION ALL SELECT rec, greatest(s, u), e, speaker, 1 FROM ow JOIN un USING (rec) WHERE e > u UNION ALL SELECT rec, greatest(s, u), e, speaker, 2 FROM oc JOIN un USING (rec) WHERE e > u)"""
_PIECES = """, bp AS (SELECT rec, s AS a FROM held WHERE e > s UNION SELECT rec, e FROM held WHERE e > s),
bq AS (SELECT rec, a, lead(a) OVER (PARTITION BY rec ORDER BY a) AS b FROM bp),
el AS (SELECT bq.rec, a, b, min({'g': g, 'speaker': speaker}) AS m FROM bq JOIN held ON held.rec = bq.rec AND held.s <= a AND held.e > a AND held.e > held.s WHERE b IS NOT NULL GROUP BY ALL),
em AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(m) OVER w = m THEN 0 ELSE 1 END AS n FROM el WINDOW w AS (PARTITION BY rec ORDER BY a)),
eg AS (SELECT *, sum(n) OVER (PARTITION BY rec ORDER BY a) AS i FROM em),
pc AS (SELECT rec, min(a) AS s, max(b) AS e, any_value(m) AS m FROM eg GROUP BY rec, i)"""


def _held(spark, sf_dir):
    t = inputs.turns(spark, sf_dir).select("rec", "start", "end", "speaker")
    until = t.select("rec").distinct().withColumn("until", 1_000_000.0 + F.col("rec") % 7 * 100_000.0)
    grouped = t.where("speaker in ('click', 'view')").join(until, "rec").where("start < until").select("rec", "start", F.least("end", "until").alias("end"), "speaker")
    own = t.where("speaker = 'purchase' and rec % 3 = 0")
    return overlay.layers(grouped, own, t.where("speaker <> 'error'"), until, REC)


@query(sql(f"""{_HELD}, hm AS (SELECT *, max(e) OVER (PARTITION BY rec, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM held),
hg AS (SELECT *, sum(CASE WHEN s <= m + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY rec, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM hm)
SELECT rec, speaker, round(min(s), 6) AS start, round(max(e), 6) AS "end" FROM hg GROUP BY rec, speaker, i""", "turns"))
def s10_current_labels(spark, sf_dir):
    found = overlay.current_labels(_held(spark, sf_dir), REC, gap=60.0)
    return found.select("rec", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(sql(f"""{_HELD}{_PIECES} SELECT rec, round(s, 6) AS start, round(e, 6) AS "end", m.speaker AS speaker, m.g AS generation FROM pc""", "turns"))
def s11_label_overlay(spark, sf_dir):
    found = overlay.overlay(_held(spark, sf_dir), REC)
    return found.select("rec", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "speaker", "generation")


@query(sql(f"""{_HELD}{_PIECES}, pt AS (SELECT event_id, rec, t + 5000 AS t FROM ev)
SELECT pt.event_id, pt.rec, pc.m.speaker AS speaker, coalesce(pc.m.g, -1) AS generation FROM pt LEFT JOIN pc ON pc.rec = pt.rec AND pc.s <= pt.t AND pt.t < pc.e""", "turns"))
def s12_retagged_frames(spark, sf_dir):
    frames = inputs.events(spark, sf_dir).select("event_id", "rec", (F.col("t") + 5000).alias("t"))
    tagged = overlay.retag(frames, overlay.overlay(_held(spark, sf_dir), REC), REC)
    return tagged.select("event_id", "rec", "speaker", F.coalesce("generation", F.lit(-1)).alias("generation"))


# halo blocks and windows: samples in blocks of sixteen

SIZE = 16


def blocks(spark, sf_dir):
    rows = inputs.levels(spark, sf_dir).withColumn("block", F.floor(F.col("i") / SIZE))
    held = rows.groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
    return held.select("rec", "block", F.transform("x", lambda r: r["value"]).alias("pcm"))


def _samples(found, first):
    """One row for each sample of each block."""
    return found.select("rec", "block", F.posexplode("pcm").alias("p", "x")).select("rec", (first + F.col("p")).alias("i"), "x")


@query(sql("\nSELECT rec, i, round(avg(value) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 34 PRECEDING AND 5 FOLLOWING), 7) AS x FROM lv", "lv"))
def s13_halo_smoothing(spark, sf_dir):
    found = halo.smooth(blocks(spark, sf_dir), REC, "block", "pcm", SIZE, 34, 5)
    return _samples(found, F.col("block") * SIZE).select("rec", "i", F.round("x", 7).alias("x"))


_TAPS = features.low_pass()


@query(sql(f""", tp AS (SELECT unnest(range({len(_TAPS)})) AS d, unnest([{', '.join(repr(float(x)) for x in _TAPS)}]) AS h),
ot AS (SELECT rec, i FROM lv WHERE i % 3 = 0) SELECT ot.rec, ot.i // 3 AS i, round(sum(h * value), 6) AS x FROM ot JOIN tp ON ot.i - d >= 0 JOIN lv ON lv.rec = ot.rec AND lv.i = ot.i - d GROUP BY ALL""", "lv"))
def s14_decimated(spark, sf_dir):
    found = features.decimate(blocks(spark, sf_dir), REC, "block", SIZE)
    return _samples(found, F.ceil(F.col("block") * SIZE / 3)).select("rec", "i", F.round("x", 6).alias("x"))


_WINDOWS = """, nb AS (SELECT rec, max(i) AS last, max(i) // 16 AS b FROM lv GROUP BY rec), wn AS (SELECT rec, last, unnest(range(0, greatest(0, b - 9) + 1)) AS w FROM nb)"""


@query(sql(f"""{_WINDOWS} SELECT wn.rec, wn.w AS "window", least(160, any_value(wn.last) + 1 - wn.w * 16)::BIGINT AS heard, round(sum(value), 6) AS total, round(sum((lv.i - wn.w * 16 + 1) * value), 4) AS placed
FROM wn JOIN lv ON lv.rec = wn.rec AND lv.i >= wn.w * 16 AND lv.i < wn.w * 16 + 160 GROUP BY wn.rec, wn.w""", "lv"))
def s15_inference_windows(spark, sf_dir):
    found = halo.inference_windows(blocks(spark, sf_dir), REC, "block", "pcm", SIZE, 10)
    total = F.aggregate("pcm", F.lit(0.0), lambda a, x: a + x)
    placed = F.aggregate(F.transform("pcm", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("rec", "window", "heard", F.round(total, 6).alias("total"), F.round(placed, 4).alias("placed"))


@query(sql(f"""{_WINDOWS} SELECT lv.rec, lv.i, greatest(0, lv.i // 16 - 9)::BIGINT AS "window", round(lv.value, 6) AS x FROM lv""", "lv"))
def s16_newest_step(spark, sf_dir):
    """Every sample once, from the window that is first to have it."""
    found = halo.inference_windows(blocks(spark, sf_dir), REC, "block", "pcm", SIZE, 10)
    samples = found.select("rec", "window", "heard", F.posexplode("pcm").alias("p", "x")).where("p < heard")
    at = F.col("window") * SIZE + F.col("p")
    return samples.where(halo.newest(F.col("window"), at, SIZE, SIZE * 10)).select("rec", at.alias("i"), "window", F.round("x", 6).alias("x"))


# confirmation, back-fill, frames of inputs


def _rounds(spark, sf_dir):
    """Four-day rounds of every recording: talk so far in minutes, the longest turn."""
    t = inputs.turns(spark, sf_dir).select("rec", "speaker", "start", F.floor(F.col("start") / 345_600).cast("int").alias("round"), (F.col("end") - F.col("start")).alias("n"))
    every = t.select("rec", "round").distinct().withColumnRenamed("round", "now")
    grown = every.join(t, "rec").where("round <= now and round > now - 3")
    found = grown.groupBy("rec", "now", "speaker").agg((F.sum("n") / 10_000).alias("talk"), (F.max("n") / 20_000).alias("longest"), F.min("start").alias("first"))
    return found.select("rec", F.col("now").alias("round"), "speaker", "talk", "longest", "first", ((F.col("speaker") == "signup") & (F.col("rec") % 5 == 0)).alias("own"))


@query(_recursive(sql(""", tr AS (SELECT rec, speaker, s, CAST(floor(s / 345600) AS INT) AS round, e - s AS n FROM turns),
ev2 AS (SELECT DISTINCT rec, round FROM tr),
vo AS (SELECT ev2.rec, ev2.round, tr.speaker, sum(n) / 10000 AS talk, max(n) / 20000 AS longest, min(s) AS first, tr.speaker = 'signup' AND ev2.rec % 5 = 0 AS own FROM ev2 JOIN tr ON tr.rec = ev2.rec AND tr.round <= ev2.round AND tr.round > ev2.round - 3 GROUP BY ev2.rec, ev2.round, tr.speaker),
ri AS (SELECT rec, round, row_number() OVER (PARTITION BY rec ORDER BY round) AS i FROM ev2),
vi AS (SELECT vo.*, ri.i FROM vo JOIN ri ON ri.rec = vo.rec AND ri.round = vo.round),
st AS (SELECT rec, CAST(0 AS BIGINT) AS i, speaker, CAST(0 AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS weak, CAST(0 AS BIGINT) AS nxt FROM (SELECT DISTINCT rec, speaker FROM vo)
UNION ALL SELECT rec, i, speaker, seen, CASE WHEN new THEN nxt + row_number() OVER (PARTITION BY rec, new ORDER BY first, speaker) - 1 ELSE ord END, weak, nxt + count(*) FILTER (WHERE new) OVER (PARTITION BY rec)
FROM (SELECT *, cand AND (strict OR (NOT anyone AND loose AND row_number() OVER (PARTITION BY rec, cand AND loose ORDER BY first, speaker) = 1)) AS new
FROM (SELECT *, coalesce(bool_or(present AND ord IS NOT NULL) OVER (PARTITION BY rec), false) AS anyone, present AND ord IS NULL AND longest >= 0.8 AS cand, own OR talk >= 2 AS loose, own OR (talk >= 2 AND talk >= 0.05 * total AND seen >= 2) AS strict
FROM (SELECT rec, i, speaker, seen, CASE WHEN gone THEN NULL ELSE ord END AS ord, CASE WHEN gone THEN 0 ELSE weak END AS weak, nxt, talk, longest, first, own, present, total
FROM (SELECT *, ord IS NOT NULL AND weak >= 2 AS gone
FROM (SELECT rec, i, speaker, CASE WHEN present THEN seen + 1 ELSE 0 END AS seen, ord, CASE WHEN ord IS NULL OR own OR most OR (talk >= 3 AND talk >= 0.03 * total) THEN 0 ELSE weak + 1 END AS weak, nxt, talk, longest, first, own, present, total
FROM (SELECT st.rec, ri.i, st.speaker, st.seen, st.ord, st.weak, st.nxt, coalesce(v.talk, 0) AS talk, coalesce(v.longest, 0) AS longest, v.first, coalesce(v.own, false) AS own, v.speaker IS NOT NULL AS present, sum(coalesce(v.talk, 0)) OVER (PARTITION BY st.rec) AS total,
v.speaker IS NOT NULL AND row_number() OVER (PARTITION BY st.rec ORDER BY v.talk DESC NULLS LAST, v.first, st.speaker) = 1 AS most
FROM st JOIN ri ON ri.rec = st.rec AND ri.i = st.i + 1 LEFT JOIN vi v ON v.rec = st.rec AND v.i = ri.i AND v.speaker = st.speaker))))))
)
SELECT st.rec, ri.round, st.speaker, CAST(ord AS INT) AS "order", CAST(row_number() OVER (PARTITION BY st.rec, st.i ORDER BY ord) - 1 AS INT) AS number FROM st JOIN ri ON ri.rec = st.rec AND ri.i = st.i WHERE ord IS NOT NULL""", "turns")))
def s17_confirmed_speakers(spark, sf_dir):
    """Who counts after each round; the state runs through a recording's rounds."""
    return confirm.confirmed(_rounds(spark, sf_dir), REC)


@query(sql(""", ck AS (SELECT DISTINCT rec, CAST(floor(t / 86400) AS BIGINT) AS chunk FROM ev WHERE speaker <> 'error'),
rn AS (SELECT *, chunk - row_number() OVER (PARTITION BY rec ORDER BY chunk) AS run FROM ck),
ps AS (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY chunk) - 1 AS p FROM rn)
SELECT rec, chunk, CAST(sum(CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY chunk) - 1 AS INT) AS turn FROM ps""", "ev"))
def s18_backlog(spark, sf_dir):
    rows = inputs.events(spark, sf_dir).select("rec", F.floor(F.col("t") / 86_400).alias("chunk"), "speaker")
    return confirm.backlog(rows, REC, F.col("speaker") != "error")


@query(sql(""", fq AS (SELECT rec, round(t / 43200) AS q, src, max(loudness) AS loudness FROM fr GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY rec, q ORDER BY loudness DESC, src) = 1 AS prim FROM fq)
SELECT rec, CAST(q AS DOUBLE) AS t, CAST(src AS INT) AS src, loudness, who AS speaker FROM bs CROSS JOIN (SELECT unnest(['home', 'none']) AS who) w WHERE CASE WHEN who = 'home' THEN src = rec % 3 ELSE prim END""", "fr"))
def s19_speaker_frames(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir).groupBy("rec", F.round(F.col("t") / 43_200).alias("t"), "src").agg(F.max("loudness").alias("loudness"))
    recs = rows.select("rec").distinct()
    homes = recs.select("rec", F.lit("home").alias("speaker"), (F.col("rec") % 3).cast("int").alias("home")).unionByName(recs.select("rec", F.lit("none").alias("speaker"), F.lit(None).cast("int").alias("home")))
    return live.frames_of(live.primary(rows, REC), homes, REC).select("rec", "t", "src", "loudness", "speaker")


# stored windows: sixteen frames, three local speakers, voices from the vectors

SHAPE = diarize.Shape(frames=16, window=8.0, step=2.0, frame_step=0.5, frame_duration=0.2)


def prepared(spark, sf_dir):
    """A recording of forty windows; which frames are active comes from the line items."""
    rows = inputs.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("w"), (F.col("l_suppkey") % 3).alias("local"), (F.col("l_partkey") % 16).alias("frame"), F.col("l_discount").alias("score"))
    mean = rows.groupBy("w", "local", "frame").agg((F.avg("score") > 0.05).alias("on"))
    marks = mean.groupBy("w", "local").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("int"), "on"))).alias("m"))
    active = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(False)))
    vecs = inputs.voiceprints(spark, sf_dir).where("vec is not null").withColumn("w", F.col("chunk") % 97)
    told = vecs.join(marks.select("w", "local", active.alias("active")), ["w", "local"])
    found = told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("local", "active", "vec"))).alias("x")).where(F.size("x") == 3)
    return found.select(F.expr("chunk div 40").alias("rec"), (F.col("chunk") % 40).alias("chunk"), F.transform("x", lambda x: x["active"]).alias("active"), F.transform("x", lambda x: x["vec"]).alias("vecs"))


@query(sql(""", mn AS (SELECT l_orderkey % 97 AS w, l_suppkey % 3 AS local, l_partkey % 16 AS frame, avg(l_discount) > 0.05 AS on_ FROM lineitem GROUP BY ALL),
ac AS (SELECT w.w, l.local, f.frame, coalesce(mn.on_, false) AS on_ FROM (SELECT DISTINCT w FROM mn) w CROSS JOIN (SELECT unnest(range(3)) AS local) l CROSS JOIN (SELECT unnest(range(16)) AS frame) f LEFT JOIN mn ON mn.w = w.w AND mn.local = l.local AND mn.frame = f.frame),
tg AS (SELECT w, frame, count(*) FILTER (WHERE on_) AS n FROM ac GROUP BY w, frame),
cl AS (SELECT ac.w, local, count(*) FILTER (WHERE on_) AS act, count(*) FILTER (WHERE on_ AND n < 2) AS clean FROM ac JOIN tg ON tg.w = ac.w AND tg.frame = ac.frame GROUP BY ac.w, local),
wi AS (SELECT chunk FROM (SELECT chunk, local FROM vp WHERE vec IS NOT NULL) x JOIN (SELECT DISTINCT w, local FROM mn) y ON y.w = x.chunk % 97 AND y.local = x.local GROUP BY chunk HAVING count(*) = 3)
SELECT wi.chunk // 40 AS rec, wi.chunk % 40 AS chunk, CAST(cl.local AS INT) AS local, CAST(CASE WHEN clean > 2 THEN clean ELSE act END AS INT) AS frames, clean <= 2 AND act > 0 AS fallback FROM wi JOIN cl ON cl.w = wi.chunk % 97""", "vp"))
def q72_clean_masks(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    masked = rows.select("rec", "chunk", F.posexplode(F.arrays_zip("active", diarize.clean_masks(F.col("active"), 2).alias("mask"))).alias("local", "x"), diarize.talking(F.col("active")).alias("all"))
    clean = F.size(F.filter(F.zip_with("x.active", "all", lambda a, n: a & (n < 2)), lambda v: v))
    act = F.size(F.filter("x.active", lambda v: v))
    return masked.select("rec", "chunk", "local", F.size(F.filter("x.mask", lambda v: v)).alias("frames"), ((clean <= 2) & (act > 0)).alias("fallback"))


@query()
def q73_diarized_turns(spark, sf_dir):
    """Turns of recordings grouped from stored windows for three speakers."""
    turns, _ = diarize.assign(cut(prepared(spark, sf_dir)), REC, 3, shape=SHAPE, cut=1.2, smallest=vectors.SMALLEST)
    return turns
