"""Queries of levels, thresholds and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonespan.operators import levels, measures, tracks
from tonespan.operators.lineage import cut
from tonespan.plans import inputs
from tonespan.plans.inputs import sql

REC = ["rec"]
QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLE_SQL[run.__name__] = oracle
        return run

    return register


@query(sql("""
SELECT rec, i // 8 AS i, round(20 * log10(greatest(sqrt(avg((value / 500) * (value / 500))), 1e-10)), 6) AS db FROM lv GROUP BY rec, i // 8 HAVING count(*) = 8""", "lv"))
def q17_block_rms_db(spark, sf_dir):
    samples = inputs.levels(spark, sf_dir).select("rec", "i", (F.col("value") / 500).alias("x"))
    return levels.block_levels(samples, REC, 8).select("rec", "i", F.round("db", 6).alias("db"))


_SLIDE = """sl0 AS (SELECT rec, i, avg(pow(10, db / 10)) OVER w AS m, count(*) OVER w AS n FROM lv WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sl AS (SELECT rec, i, 10 * log10(greatest(m, 1e-20)) AS db FROM sl0 WHERE n = 5)"""


@query(sql(f", {_SLIDE} SELECT rec, i, round(db, 6) AS db FROM sl", "lv"))
def q18_sliding_energy_db(spark, sf_dir):
    return levels.sliding_levels(inputs.levels(spark, sf_dir), REC).select("rec", "i", F.round("db", 6).alias("db"))


_OTSU = """r AS (SELECT rec, min(db) AS lo, max(db) AS hi FROM lv WHERE db > -120 GROUP BY rec HAVING count(*) > 1),
hb AS (SELECT lv.rec, lo, hi, least(255, CAST(floor((db - lo) / (hi - lo) * 256) AS INT)) AS b, count(*) AS c FROM lv JOIN r USING (rec) WHERE db > -120 GROUP BY ALL),
hm AS (SELECT rec, b, c, lo + (b + 0.5) * (hi - lo) / 256 AS mid FROM hb),
hc AS (SELECT rec, b, mid, sum(c) OVER w AS w0, sum(c) OVER (PARTITION BY rec) AS w, sum(c * mid) OVER w AS s0, sum(c * mid) OVER (PARTITION BY rec) AS s FROM hm WINDOW w AS (PARTITION BY rec ORDER BY b ROWS UNBOUNDED PRECEDING)),
hs AS (SELECT rec, b, mid, w0 * (w - w0) * pow(s0 / greatest(w0, 1) - (s - s0) / greatest(w - w0, 1), 2) AS sc FROM hc),
ot AS (SELECT rec, arg_min(mid, (-sc, b)) AS split FROM hs GROUP BY rec)"""
_FLOOR = """fv AS (SELECT lv.rec, split, quantile_cont(db, 0.5) FILTER (WHERE db <= split) AS fl, coalesce(quantile_cont(db, 0.5) FILTER (WHERE db > split), split) AS vo FROM lv JOIN ot USING (rec) GROUP BY lv.rec, split),
me AS (SELECT *, greatest(fl + 6, vo - 30) AS au FROM fv)"""


@query(sql(f", {_OTSU} SELECT rec, round(split, 6) AS split FROM ot", "lv"))
def q19_otsu(spark, sf_dir):
    return levels.otsu(inputs.levels(spark, sf_dir), REC).select("rec", F.round("split", 6).alias("split"))


def _measured(spark, sf_dir):
    rows = inputs.levels(spark, sf_dir)
    return levels.floor_and_voice(rows, levels.otsu(rows, REC), REC)


@query(sql(f', {_OTSU}, {_FLOOR} SELECT rec, round(fl, 6) AS "floor", round(vo, 6) AS voice FROM me', "lv"))
def q20_floor_voice(spark, sf_dir):
    return _measured(spark, sf_dir).select("rec", F.round("floor", 6).alias("floor"), F.round("voice", 6).alias("voice"))


@query(sql(f", {_OTSU}, {_FLOOR} SELECT rec, round(au, 6) AS audible FROM me", "lv"))
def q21_audible_level(spark, sf_dir):
    return _measured(spark, sf_dir).select("rec", F.round("audible", 6).alias("audible"))


START, SHORTEST, PAD = 34, 2, 0.01


def _swept(spark, sf_dir):
    rows = inputs.levels(spark, sf_dir)
    measured = cut(_measured(spark, sf_dir))
    tried = levels.thresholds(measured, REC, START)
    long_ = rows.groupBy("rec").agg((F.count(F.lit(1)) * levels.HOP).alias("duration"))
    kept, gaps = levels.sweep(rows, tried, long_, REC, levels.HOP, SHORTEST, PAD)
    return rows, measured, tried, kept, gaps


_SWEEP = f"""th AS (SELECT rec, unnest(generate_series(least({START}, CAST(floor(fl + 3) AS INT)), {START})) AS th FROM me),
du AS (SELECT rec, count(*) * 0.01 AS d FROM lv GROUP BY rec),
q0 AS (SELECT lv.rec, th, i, i - row_number() OVER (PARTITION BY lv.rec, th ORDER BY i) AS g FROM lv JOIN th USING (rec) WHERE db < th),
si AS (SELECT rec, th, min(i) * 0.01::DOUBLE AS s, (max(i) + 1) * 0.01::DOUBLE AS e FROM q0 GROUP BY rec, th, g HAVING count(*) >= {SHORTEST}),
x1 AS (SELECT rec, th, s, e, 0 AS z FROM si UNION ALL SELECT rec, th, d::DOUBLE, NULL, 1 FROM th JOIN du USING (rec)),
x2 AS (SELECT rec, th, coalesce(lag(e) OVER (PARTITION BY rec, th ORDER BY z, s, e), 0.0) AS f, s FROM x1),
x3 AS (SELECT x2.rec, th, greatest(0.0, f - {PAD}) AS s, least(d, s + {PAD}) AS e FROM x2 JOIN du USING (rec) WHERE s > f),
x4 AS (SELECT *, max(e) OVER (PARTITION BY rec, th ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x3),
x5 AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY rec, th ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x4),
kp AS (SELECT rec, th, min(s) AS s, max(e) AS e FROM x5 GROUP BY rec, th, g)"""
_LOSS = f"""{_SLIDE}, y1 AS (SELECT rec, th, s, e, 0 AS z FROM kp UNION ALL SELECT rec, th, d::DOUBLE, NULL, 1 FROM th JOIN du USING (rec)),
y2 AS (SELECT rec, th, coalesce(lag(e) OVER (PARTITION BY rec, th ORDER BY z, s, e), 0.0) AS s, s AS e FROM y1),
ga AS (SELECT rec, th, s, e, ceil(s / 0.01) AS lo, floor(e / 0.01) - 4 AS hi FROM y2 WHERE e > s),
hi AS (SELECT ga.rec, th, ga.s, ga.e, sl.i, sl.db FROM ga JOIN sl ON sl.rec = ga.rec AND sl.i >= lo AND sl.i < hi JOIN me ON me.rec = ga.rec WHERE db > au),
hc2 AS (SELECT *, least(5, coalesce(lead(i) OVER (PARTITION BY rec, th, s, e ORDER BY i) - i, 5)) AS c FROM hi),
ls AS (SELECT rec, th, s, e, sum(c) * 0.01::DOUBLE AS au_s, max(db) AS peak FROM hc2 GROUP BY rec, th, s, e),
tr AS (SELECT th.rec, th.th, coalesce((SELECT sum(e - s) FROM kp WHERE kp.rec = th.rec AND kp.th = th.th), 0) AS kept, coalesce((SELECT sum(au_s) FROM ls WHERE ls.rec = th.rec AND ls.th = th.th), 0) AS lost FROM th)"""


@query(sql(f", {_OTSU}, {_FLOOR}, {_SWEEP} SELECT rec, CAST(th AS INT) AS threshold, count(*) AS segments, round(sum(e - s), 4) AS kept FROM kp GROUP BY rec, th", "lv"))
def q22_sweep(spark, sf_dir):
    kept = _swept(spark, sf_dir)[3]
    return kept.groupBy("rec", "threshold").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("kept"))


@query(sql(f", {_OTSU}, {_FLOOR}, {_SWEEP}, {_LOSS} SELECT rec, CAST(coalesce(max(th) FILTER (WHERE lost <= 0.5), arg_min(th, (round(lost, 6), -th))) AS INT) AS chosen FROM tr GROUP BY rec", "lv"))
def q23_choose(spark, sf_dir):
    rows, measured, tried, kept, gaps = _swept(spark, sf_dir)
    losses = levels.audible_loss(gaps, levels.sliding_levels(rows, REC), measured, REC)
    rounded = levels.trials(kept, losses, tried, REC).withColumn("lost", F.round("lost", 6))
    return levels.choose(rounded, REC, 0.5)


@query(sql(f', {_OTSU}, {_FLOOR}, {_SWEEP}, {_LOSS} SELECT rec, CAST(th AS INT) AS threshold, count(*) AS gaps, round(sum(au_s), 4) AS lost, round(max(peak), 6) AS peak FROM ls GROUP BY rec, th', "lv"))
def q24_audible_loss(spark, sf_dir):
    rows, measured, _, _, gaps = _swept(spark, sf_dir)
    losses = levels.audible_loss(gaps, levels.sliding_levels(rows, REC), measured, REC)
    return losses.groupBy("rec", "threshold").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.sum("audible_seconds"), 4).alias("lost"), F.round(F.max("peak"), 6).alias("peak"))


# Tracks: rec = user % 4, an input for each event type, a frame for each hour.
FRAMES, HOUR = 720, 3600.0
KINDS = ("click", "error", "purchase", "signup", "view")
_TR = f"""kd AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i})" for i, k in enumerate(KINDS))}) AS k(kind, input)),
tv AS (SELECT rec % 4 AS rec, input, CAST(floor(t / {HOUR}) AS BIGINT) AS i, sum(value) AS v FROM ev JOIN kd ON kind = speaker GROUP BY ALL),
tl AS (SELECT r.rec, kd.input, g.i, coalesce(10 * log10(v), -20.0) AS db FROM (SELECT DISTINCT rec % 4 AS rec FROM ev) r, kd, (SELECT unnest(range({FRAMES})) AS i) g LEFT JOIN tv ON tv.rec = r.rec AND tv.input = kd.input AND tv.i = g.i)"""
_AC = "tt AS (SELECT rec, input, greatest(quantile_cont(db, 0.1) + 15, quantile_cont(db, 0.99) - 35, -75) AS th FROM tl GROUP BY ALL), ac AS (SELECT rec, input, i FROM tl JOIN tt USING (rec, input) WHERE db > th)"
_MIXED = "mx AS (SELECT rec, i, 10 * log10(sum(pow(10, db / 10)) + 1e-20) AS db FROM tl GROUP BY rec, i)"


def _track_levels(spark, sf_dir):
    kinds = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rows = inputs.events(spark, sf_dir).select((F.col("rec") % 4).alias("rec"), kinds[F.col("speaker")].alias("input"), F.floor(F.col("t") / HOUR).alias("i"), "value")
    sums = rows.groupBy("rec", "input", "i").agg(F.sum("value").alias("v"))
    grid = rows.select("rec").distinct().select("rec", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1))).alias("input")).select("rec", "input", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"))).alias("i"))
    return grid.join(sums, ["rec", "input", "i"], "left").select("rec", "input", "i", F.coalesce(10 * F.log10("v"), F.lit(-20.0)).alias("db"))


def _mix(rows):
    power = F.sum(F.pow(F.lit(10.0), F.col("db") / 10))
    return rows.groupBy("rec", "i").agg((10 * F.log10(power + 1e-20)).alias("db"))


@query(sql(f", {_TR}, {_AC} SELECT rec, input, round(th, 6) AS threshold FROM tt", "ev"))
def q25_track_threshold(spark, sf_dir):
    return tracks.track_thresholds(_track_levels(spark, sf_dir), REC).select("rec", "input", F.round("threshold", 6).alias("threshold"))


def _active(spark, sf_dir):
    rows = _track_levels(spark, sf_dir)
    return tracks.activity(rows, tracks.track_thresholds(rows, REC), REC)


@query(sql(f", {_TR}, {_AC} SELECT rec, input, i FROM ac", "ev"))
def q26_activity(spark, sf_dir):
    return _active(spark, sf_dir).select("rec", "input", "i")


@query(sql(f""", {_TR}, {_MIXED}, p AS (SELECT mx.rec, l.lag, greatest(mx.db, -80) AS a, greatest(tl.db, -80) AS b FROM mx, (SELECT unnest(generate_series(-25, 25)) AS lag) l JOIN tl ON tl.rec = mx.rec AND tl.i = mx.i - l.lag AND tl.input = 4)
SELECT rec, CAST(lag AS INT) AS lag, round(corr(a, b), 6) AS r FROM p GROUP BY rec, lag HAVING count(*) >= 50 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0""", "ev"))
def q27_lag_sweep(spark, sf_dir):
    rows = _track_levels(spark, sf_dir)
    found = tracks.lag_correlations(_mix(rows), rows.where("input = 4"), REC)
    return found.select("rec", "lag", F.round("r", 6).alias("r"))


@query(sql(f", {_TR} SELECT rec, input, i, round(lag(db, 3, -200.0) OVER (PARTITION BY rec, input ORDER BY i), 6) AS db FROM tl", "ev"))
def q28_shift(spark, sf_dir):
    moved = tracks.shift(_track_levels(spark, sf_dir), ["rec", "input"], 3)
    return moved.select("rec", "input", "i", F.round("db", 6).alias("db"))


def _track_turns(spark, sf_dir):
    return inputs.events(spark, sf_dir).select((F.col("rec") % 4).alias("rec"), "speaker", F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"))


_GRID = f"""gr AS (SELECT DISTINCT rec % 4 AS rec, speaker, unnest(range(greatest(0, CAST(floor(t / {HOUR}) AS BIGINT)), least({FRAMES}, CAST(ceil((t + value * 60) / {HOUR}) AS BIGINT)))) AS frame FROM ev),
al AS (SELECT rec, i AS frame, min(input) AS input FROM ac GROUP BY rec, i HAVING count(*) = 1),
sg AS (SELECT rec, frame, min(speaker) AS speaker FROM gr GROUP BY rec, frame HAVING count(*) = 1),
so AS (SELECT rec, speaker, input, count(*) AS n FROM sg JOIN al USING (rec, frame) GROUP BY ALL),
ho AS (SELECT rec, speaker, CAST(arg_max(input, (n, -input)) AS INT) AS input FROM so GROUP BY rec, speaker HAVING sum(n) >= 3 AND max(n) / sum(n) >= 0.3)"""
_SHARES = dict(hop=HOUR, frames=FRAMES, evidence=3 * HOUR)


@query(sql(f", {_TR}, {_AC}, {_GRID} SELECT rec, speaker, input FROM ho", "ev"))
def q29_homes(spark, sf_dir):
    return tracks.homes(_track_turns(spark, sf_dir), _active(spark, sf_dir), REC, share=0.3, **_SHARES)


@query(sql(f""", {_TR}, {_AC}, {_GRID}, one AS (SELECT rec, input, min(speaker) AS speaker FROM ho GROUP BY rec, input HAVING count(*) = 1),
he AS (SELECT al.rec, al.input, one.speaker, count(gr.frame) / count(*) AS sh FROM al JOIN (SELECT DISTINCT rec, frame FROM gr) a USING (rec, frame) JOIN one USING (rec, input) LEFT JOIN gr ON gr.rec = al.rec AND gr.frame = al.frame AND gr.speaker = one.speaker GROUP BY ALL)
SELECT rec, input, speaker FROM he WHERE sh >= 0.3""", "ev"))
def q30_own(spark, sf_dir):
    turns, active = _track_turns(spark, sf_dir), _active(spark, sf_dir)
    home = tracks.homes(turns, active, REC, share=0.3, **_SHARES)
    own = tracks.own_inputs(home, turns, active, REC, HOUR, FRAMES, 0.3)
    return own.select("rec", F.col("input").cast("int").alias("input"), "speaker")


def _runs_sql(name: str, frames: str) -> str:
    """Spans of runs of the frames (rec, speaker, frame) of ``frames``, joined across an hour,
    those under an hour dropped."""
    return f"""{name}0 AS (SELECT rec, speaker, min(frame) AS a, max(frame) + 1 AS b FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec, speaker ORDER BY frame) AS g FROM {frames}) GROUP BY rec, speaker, g),
{name}1 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY rec, speaker ORDER BY a) <= 1 THEN 0 ELSE 1 END AS n FROM {name}0),
{name}2 AS (SELECT *, sum(n) OVER (PARTITION BY rec, speaker ORDER BY a) AS g FROM {name}1),
{name} AS (SELECT rec, speaker, min(a) AS a, max(b) AS b FROM {name}2 GROUP BY rec, speaker, g HAVING max(b) - min(a) >= 1)"""


@query(sql(f""", {_TR}, {_AC}, {_GRID}, one AS (SELECT rec, input, min(speaker) AS speaker FROM ho GROUP BY rec, input HAVING count(*) = 1),
he AS (SELECT al.rec, al.input, one.speaker, count(gr.frame) / count(*) AS sh FROM al JOIN (SELECT DISTINCT rec, frame FROM gr) a USING (rec, frame) JOIN one USING (rec, input) LEFT JOIN gr ON gr.rec = al.rec AND gr.frame = al.frame AND gr.speaker = one.speaker GROUP BY ALL),
ow AS (SELECT rec, input, speaker FROM he WHERE sh >= 0.3),
sp AS (SELECT DISTINCT rec % 4 AS rec, unnest(range(greatest(0, CAST(floor((t - {2 * HOUR}) / {HOUR}) AS BIGINT)), least({FRAMES}, CAST(ceil((t + value * 60 + {2 * HOUR}) / {HOUR}) AS BIGINT)))) AS frame FROM ev),
so2 AS (SELECT DISTINCT ow.rec, ow.speaker, ac.i AS frame FROM ac JOIN ow USING (rec, input) JOIN sp ON sp.rec = ac.rec AND sp.frame = ac.i), {_runs_sql("rd", "so2")},
od AS (SELECT DISTINCT rec, unnest(range(a, least({FRAMES}, b))) AS frame FROM rd),
ot AS (SELECT DISTINCT gr.rec, gr.speaker, gr.frame FROM gr WHERE rec IN (SELECT rec FROM ow) AND (rec, speaker) NOT IN (SELECT rec, speaker FROM ow) AND (rec, frame) NOT IN (SELECT rec, frame FROM od)), {_runs_sql("rs", "ot")}
SELECT rec, speaker, round(a * {HOUR}, 3) AS start, round(b * {HOUR}, 3) AS "end" FROM rd UNION ALL SELECT rec, speaker, round(a * {HOUR}, 3), round(b * {HOUR}, 3) FROM rs
UNION ALL SELECT rec % 4, speaker, round(t, 3), round(t + value * 60, 3) FROM ev WHERE rec % 4 NOT IN (SELECT rec FROM ow)""", "ev"))
def q31_refine(spark, sf_dir):
    turns, active = _track_turns(spark, sf_dir), _active(spark, sf_dir)
    out, _ = tracks.refine(turns, active, REC, HOUR, FRAMES, 3 * HOUR, 0.3, 0.3, 2 * HOUR, HOUR, HOUR, HOUR)
    return out.select("rec", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(sql(f""", {_TR}, {_MIXED}, bo AS (SELECT rec, i, 10 * log10(sum(pow(10, db / 10)) + 1e-20) AS b FROM tl WHERE input < 3 GROUP BY rec, i)
SELECT mx.rec, round(corr(db, b), 6) AS r, count(*) > 50 AND corr(db, b) > 0.8 AS is_mix FROM mx JOIN bo USING (rec, i) WHERE greatest(db, b) > -80 GROUP BY mx.rec""", "ev"))
def q32_is_mix_of(spark, sf_dir):
    rows = _track_levels(spark, sf_dir)
    found = tracks.mix_likeness(_mix(rows), rows.where("input < 3"), REC)
    return found.select("rec", F.round("r", 6).alias("r"), "is_mix")


@query(sql(f", {_TR} SELECT rec, i, input FROM (SELECT rec, i, input, row_number() OVER (PARTITION BY rec, i ORDER BY round(db, 6) DESC, input) AS p FROM tl) WHERE p = 1", "ev"))
def q67_loudest_input(spark, sf_dir):
    return tracks.loudest(_track_levels(spark, sf_dir), REC).select("rec", "i", "input")


@query(sql(f", {_TR} SELECT rec, input, i, round(db, 6) AS db FROM tl WHERE i BETWEEN 40 AND 139", "ev"))
def q68_page(spark, sf_dir):
    return measures.page(_track_levels(spark, sf_dir), "i", 40, 100).select("rec", "input", "i", F.round("db", 6).alias("db"))


@query(sql(f""", {_TR}, n AS (SELECT rec, input, max(i) AS last FROM tl GROUP BY ALL)
SELECT rec, input, CAST(floor(i * 50 / (last + 1)) AS INT) AS pixel, round(avg(db), 6) AS mean, count(*) AS n FROM tl JOIN n USING (rec, input) GROUP BY ALL""", "ev"))
def q69_pixel_means(spark, sf_dir):
    found = measures.pixel_means(_track_levels(spark, sf_dir), ["rec", "input"], "i", "db", 50)
    return found.select("rec", "input", "pixel", F.round("mean", 6).alias("mean"), "n")


@query(sql(f""", {_TR}, {_MIXED}, p AS (SELECT mx.rec, tl.input, l.lag, greatest(mx.db, -80) AS a, greatest(tl.db, -80) AS b FROM mx, (SELECT unnest(generate_series(-25, 25)) AS lag) l JOIN tl ON tl.rec = mx.rec AND tl.i = mx.i - l.lag WHERE mx.i < 480 AND tl.i < 480),
co AS (SELECT rec, input, lag, round(corr(a, b), 12) AS r FROM p GROUP BY rec, input, lag HAVING count(*) >= 50 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT x.rec, x.input, CAST(coalesce(arg_min(lag, (-r, lag)), 0) * 3600 AS DOUBLE) AS lag FROM (SELECT DISTINCT rec, input FROM tl) x LEFT JOIN co USING (rec, input) GROUP BY x.rec, x.input""", "ev"))
def q75_input_lags(spark, sf_dir):
    """From the first 480 hours."""
    rows = _track_levels(spark, sf_dir)
    return tracks.input_lags(_mix(rows), rows, REC, HOUR, 25 * HOUR, 480 * HOUR)
