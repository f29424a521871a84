"""Levels, vectors, measures and live operators on small cases."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonespan.operators import decode, levels, measures, tracks, vectors
from tonespan.streaming import live


def test_otsu_matches_a_histogram_sweep(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(-60, 3, 300), rng.normal(-20, 4, 200)])
    df = spark.createDataFrame([(0, float(v)) for v in values], "rec int, db double")
    got = levels.otsu(df, ["rec"]).first().split
    hist, edges = np.histogram(values, 256)
    mid = (edges[1:] + edges[:-1]) / 2
    best = max(range(256), key=lambda k: (lambda a, b: a.sum() * b.sum() * ((a * mid[: k + 1]).sum() / max(a.sum(), 1) - (b * mid[k + 1 :]).sum() / max(b.sum(), 1)) ** 2)(hist[: k + 1], hist[k + 1 :]))
    assert got == pytest.approx(mid[best])


def test_partial_blocks_are_dropped(spark):
    df = spark.createDataFrame([(0, i, 0.5) for i in range(10)], "rec int, i long, x double")
    got = levels.block_levels(df, ["rec"], 4)
    assert sorted((r.i, round(r.db, 3)) for r in got.collect()) == [(0, -6.021), (1, -6.021)]


def test_choose_prefers_the_highest_that_loses_nothing(spark):
    rows = [(0, -25, 3.0), (0, -26, 0.0), (0, -27, 0.0), (1, -25, 2.0), (1, -26, 1.0), (1, -27, 1.0)]
    df = spark.createDataFrame(rows, "rec int, threshold int, lost double")
    assert {r.rec: r.chosen for r in levels.choose(df, ["rec"]).collect()} == {0: -26, 1: -26}


def test_lag_is_found(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(-70, -10, 300)
    mix = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(base)], "rec int, i long, db double")
    track = spark.createDataFrame([(0, i, float(base[i + 7])) for i in range(293)], "rec int, i long, db double")
    assert tracks.best_lag(tracks.lag_correlations(mix, track, ["rec"]), ["rec"]).first().lag == 7


def _plain_linkage(points):
    groups, out = {k: [k] for k in range(len(points))}, []
    while len(groups) > 1:
        mean = {k: points[m].mean(axis=0) for k, m in groups.items()}
        apart, a, b = min((float(np.linalg.norm(mean[a] - mean[b])), a, b) for a in groups for b in groups if a < b)
        groups[len(points) + len(out)] = groups.pop(a) + groups.pop(b)
        out.append((a, b, apart, len(groups[len(points) + len(out)])))
    return np.array(out)


def test_linkage_and_wanted_number_match_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(5):
        points = rng.normal(size=(40, 5)) + 3 * rng.normal(size=(4, 5))[rng.integers(0, 4, 40)]
        tree, plain = vectors.linkage(points), _plain_linkage(points)
        assert np.allclose(tree, plain)
        need, cut = 4, 2.0
        for wanted in (2, 3, 5, 9, 30):
            groups, large = {k: 1 for k in range(40)}, []
            for k, (a, b, _, _) in enumerate(plain):
                groups[40 + k] = groups.pop(int(a)) + groups.pop(int(b))
                large.append(sum(v >= need for v in groups.values()))
            best, off = 39, abs(1 - wanted)
            for k in sorted(range(39), key=lambda k: abs(plain[k, 2] - cut)):
                if plain[k, 3] >= need and abs(large[k] - wanted) < off:
                    best, off = k + 1, abs(large[k] - wanted)
            assert vectors.merges_for(tree, 40, need, wanted, cut) == best


def test_speakers_of_a_known_number(spark):
    rng = np.random.default_rng(2)
    voices = np.eye(6)[:4]
    rows = [(rec, k, [float(x) for x in voices[k % 4] + rng.normal(0, 0.05, 6)], 1.0 + (k % 4 == 2)) for rec in range(2) for k in range(80)]
    df = spark.createDataFrame([*rows, (0, 99, None, 1.0)], "rec int, item int, vec array<double>, seconds double")
    for n, want in ((None, 4), (1, 1), (2, 2), (4, 4), (6, 6)):
        got = vectors.speakers(df, ["rec"], "item", n=n).collect()
        assert len(got) == 160
        for rec in range(2):
            own = {r.item: r.speaker for r in got if r.rec == rec}
            if n != 6:  # no sixth voice: as near as groups of a tenth allow
                assert set(own.values()) == set(range(want))
                assert all(own[k] == own[k % 4] for k in own)
            assert own[2] == 0
    assert vectors.speakers(df.where("false"), ["rec"], "item", n=2).count() == 0


def test_refine_reads_an_own_input(spark):
    # speaker 0 alone on input 0, speaker 1 alone on input 1
    active = [(0, 0, i) for i in range(0, 300)] + [(0, 1, i) for i in range(400, 700)]
    turns = [(0, 0.0, 6.2, 0), (0, 8.0, 14.0, 1)]
    a = spark.createDataFrame(active, "rec int, input int, i long")
    t = spark.createDataFrame(turns, "rec int, start double, end double, speaker int")
    out, home = tracks.refine(t, a, ["rec"])
    assert {r.speaker: r.input for r in home.collect()} == {0: 0, 1: 1}
    assert sorted((round(r.start, 2), round(r.end, 2), r.speaker) for r in out.collect()) == [(0.0, 6.0, 0), (8.0, 14.0, 1)]


def test_binarize_keeps_state_at_one_half(spark):
    values = [0.5, 0.9, 0.5, 0.4, 0.5, 0.7, 0.7]
    df = spark.createDataFrame([(0, 1, i, v) for i, v in enumerate(values)], "rec int, k int, frame long, value double")
    got = decode.binarize(df, ["rec"], len(values), step=1.0, duration=0.0)
    assert sorted((r.start, r.end) for r in got.collect()) == [(1.0, 3.0), (5.0, 6.0)]


def test_linkage_and_cut():
    points = np.array([[1, 0], [0.99, 0.05], [0, 1], [0.05, 0.99], [-1, 0]], float)
    tree = vectors.linkage(points)
    assert tree[-1, 3] == 5
    assert len(set(vectors.cut_tree(tree, 5, 0.3).tolist())) == 3
    assert vectors.cut_tree(tree, 5, 10.0).tolist() == [0] * 5
    assert vectors.group_vectors(points[:1]).tolist() == [0]


def test_assignment_is_best_of_all():
    rng = np.random.default_rng(3)
    for rows, columns in ((3, 3), (2, 5), (5, 2), (4, 4), (1, 1)):
        for _ in range(20):
            score = rng.integers(0, 9, (rows, columns)).astype(float)
            got = sum(score[i, j] for i, j in vectors.assignment(score))
            small, large = min(rows, columns), max(rows, columns)
            wide = score if rows <= columns else score.T
            best = max(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
            assert got == best


def test_families_and_fold():
    v = np.array([1.0, 0.0])
    w = np.array([0.0, 1.0])
    groups = {0: vectors.Group(10, 5, v), 1: vectors.Group(3, 2, v + 0.1), 2: vectors.Group(5, 3, w), 3: vectors.Group(0.5, 0.2, w)}
    assert vectors.family_of(groups) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert set(vectors.fold(groups, 1).values()) == {0}
    assert vectors.fold(groups, 3)[3] == 2


def test_bins_of_equal_count(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "rec int, i int, v double")
    got = measures.bin_equal(df, ["rec"], "i", "v", 3)
    edges = np.linspace(0, 10, 4).astype(int)
    assert [r.value for r in got.orderBy("bin").collect()] == [float(np.median(np.arange(a, b))) for a, b in zip(edges, edges[1:], strict=False)]


def test_change_point_finds_the_step(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i * 0.05, float(rng.normal(0.0 if i < 1200 else 0.1, 0.02))) for i in range(2400)]
    df = spark.createDataFrame(rows, "rec int, t double, r double")
    found = measures.change_point(df, ["rec"], 0.05).first()
    assert found.at == 60.0 and found.change and found.pct == pytest.approx(10.5, abs=1)


def test_placement(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.01, 1.0), (0, 0.2, 0.3), (0, 5.0, 1.0)], "rec int, at double, length double")
    got = {r["at"]: r for r in live.place(df, ["rec"]).collect()}
    assert got[1.01].start == 1.0 and got[5.0].start == 5.0 and got[0.2].late and not got[5.0].late


def test_stream_labels_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("s", i, (np.eye(4)[i % 3] + rng.normal(0, 0.05, 4)).tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, "rec string, i long, vec array<double>")
    batch = {r.i: r.speaker for r in live.label_online(df, ["rec"], "i").collect()}
    for part in range(4):
        df.where(F.col("i").between(part * 6, part * 6 + 5)).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    stream = spark.readStream.schema("rec string, i long, vec array<double>, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    labelled = live.label_stream(stream, "rec", "i")
    query = labelled.writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.i: r.speaker for r in spark.table("labels").collect()} == batch
    assert set(batch.values()) == {0, 1, 2}


def test_confirmation_needs_two_rounds(spark):
    rows = [(0, 0, 5, 3.0, 1.0, 0.0, False), (0, 0, 6, 3.0, 1.0, 1.0, False), (0, 1, 5, 5.0, 1.0, 0.0, False), (0, 1, 6, 4.0, 1.0, 1.0, False), (0, 1, 7, 9.0, 2.0, 2.0, True)]
    df = spark.createDataFrame(rows, "rec int, round int, speaker int, talk double, longest double, first double, own boolean")
    assert [r.speaker for r in live.confirm(df, ["rec"]).orderBy("order").collect()] == [5, 6, 7]


def test_decimation_in_blocks_equals_the_whole():
    from tonespan.operators import features

    x = np.random.default_rng(5).normal(size=5000)
    whole = features.Decimator().push(x)
    cuts = [0, 1, 2, 130, 131, 999, 3100, 5000]
    one = features.Decimator()
    assert np.allclose(np.concatenate([one.push(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]), whole)
    assert len(whole) == 1667


def test_delay_of_a_recording():
    from tonespan.operators import features

    x = np.random.default_rng(6).normal(size=features.RATE * 2)
    for lag in (0, 341, 1024, 5000):
        assert features.delay(x, np.concatenate((np.zeros(lag), x, np.zeros(8000)))) == lag
    assert features.delay(x[:100], x) == 0


def test_log_mel_shape_and_centre():
    from tonespan.operators import features

    tone = np.sin(np.arange(16_000) * 2 * np.pi * 1000 / 16_000)
    tone[:8000] *= 0.1
    found = features.log_mel(tone)
    assert found.shape == (98, 80) and np.allclose(found.mean(axis=0), 0, atol=1e-4)
    assert features.mel_weights().shape == (257, 80) and np.all(features.mel_weights()[-1] == 0)
    assert features.log_mel(tone[:399]).shape == (0, 80)


def test_stable_ids_of_every_recording(spark, tmp_path):
    from tonespan.plans import voice_queries

    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(30, 60)), f"s{rng.integers(3)}", int(rng.integers(0, 4000)), float(rng.integers(1, 6))) for k in range(400)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at int, value double")
    made.select("event_id", "user_id", "event_type", F.expr("timestampadd(SECOND, at, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    shared = {}
    for _, rec, old, a, v in rows:
        for event, other, _, b, w in rows:
            if other == rec and (both := min(a + v * 600, b + w * 600) - max(a, b)) > 0:
                table = shared.setdefault(rec, {})
                table[event % 4, old] = table.get((event % 4, old), 0.0) + both
    got = {}
    for r in voice_queries.q46_stable_ids(spark, str(tmp_path)).collect():
        got.setdefault(r.rec, []).append((r.new, r.old))
    assert got.keys() == shared.keys() and max(got) > 40
    for rec, table in shared.items():
        olds = [f"s{k}" for k in range(3)] + [None]
        best = max(sum(table.get((n, o), 0.0) for n, o in enumerate(p)) for p in itertools.permutations(olds))
        assert len({n for n, _ in got[rec]}) == len({o for _, o in got[rec]}) == len(got[rec])
        assert sum(table[p] for p in got[rec]) == pytest.approx(best)


def test_nearest_of_many_centers(spark):
    rng = np.random.default_rng(11)
    centers = {k: rng.normal(size=6) for k in range(vectors.CENTROIDS_AT_ONCE * 2 + 40)}
    x = np.concatenate([rng.normal(size=(60, 6)), [centers[7], centers[7] * 2]])
    rows = spark.createDataFrame([(k % 61, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist())], "k int, vec array<double>")
    table = spark.createDataFrame([(k, v.tolist()) for k, v in centers.items()], "speaker int, vec array<double>")
    got = vectors.nearest(rows, table).collect()
    c = np.stack([centers[k] for k in sorted(centers)])
    assert len(got) == 63 and sum(r.k == 5 for r in got) == 2
    for r in got:
        like = c @ np.array(r.vec) / (np.linalg.norm(c, axis=1) * np.linalg.norm(r.vec))
        assert r.speaker == int(like.round(12).argmax()) and r.likeness == pytest.approx(like.max(), abs=1e-9)
    few = vectors.nearest(rows, table.where("speaker < 5")).collect()
    assert len(few) == 63 and {r.speaker for r in few} <= set(range(5))
    assert {r.speaker for r in vectors.nearest(rows, table.where("false")).collect()} == {None}


def test_trend_equals_brute_force_at_the_edges_of_windows(spark):
    """Also where a step is no whole number of microseconds; rows without a residual are not
    moments of the trend."""
    rng = random.Random(54)
    for step, window, near in ((0.5, 4.0, 0.75), (0.3333337, 1.7, 0.1)):
        edges = [(k + 0.5) * step + side * d for k in range(12) for d in (window / 2, near) for side in (-1, 1)]
        moments = [max(0.0, t + e * 1e-6) for t in edges for e in (-1, 0, 1)] + [rng.uniform(0, 9) for _ in range(60)]
        rows = [(rec, t, rng.uniform(-0.2, 0.2) if rng.random() < 0.9 else None) for rec in (0, 1) for t in moments if rec == 0 or t < 2]
        got = {(x.rec, round(x.t, 7)): (x.pct, x.conf) for x in measures.trend(spark.createDataFrame(rows, "rec int, t double, r double"), ["rec"], 9.0, 0.01, step, window, near, 2.0).collect()}
        want = {}
        for rec in (0, 1):
            known = [(math.floor(t * 1e6 + 0.5), r) for key, t, r in rows if key == rec and r is not None]
            for k in range(int(9.0 / step) + 1):
                t = k * step + step / 2
                u, half, close = math.floor(t * 1e6 + 0.5), round(window / 2 * 1e6), round(near * 1e6)
                wide = [r for m, r in known if u - half <= m < u + half]
                if t < 9.0 and any(u - close <= m < u + close for m, _ in known):
                    want[rec, round(t, 7)] = (pytest.approx(100 * (math.exp(sum(wide) / len(wide)) - 1)), pytest.approx(min(1.0, len(wide) * 0.01 / 2.0)))
        assert got == want and len(want) > 20


def test_trend_of_many_rows_in_one_window(spark):
    """The work follows the rows, not the rows times the rows of a window."""
    n = 300_000
    rows = spark.range(n).select(F.lit(0).alias("rec"), (F.col("id") * (20.0 / n)).alias("t"), F.lit(0.01).alias("r"))
    begin = time.perf_counter()
    found = measures.trend(rows, ["rec"], 20.0, 0.001, step=5.0, window=40.0).collect()
    assert len(found) == 4 and {round(x.pct, 6) for x in found} == {round(100 * (math.exp(0.01) - 1), 6)}
    assert time.perf_counter() - begin < 60
