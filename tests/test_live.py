"""Live sessions: aligned inputs in batch and stream, labels that hold, halo blocks, windows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonespan.operators import features, halo
from tonespan.streaming import aligned, confirm, live, overlay, regroup, windows

CHUNK = "rec string, inputs int, source int, at long, pcm array<double>, arrived long, ended boolean"
CLOCK = aligned.Clock(rate=160)


def session(rng, name, inputs=3, chunks=200):
    rows, last = [], 0
    for source in range(inputs):
        for k in range(chunks):
            n = 8 + 4 * (rng.random() < 0.1)
            if rng.random() > 0.06:
                arrived = k * 8 + n + rng.randrange(30) + 1200 * (rng.random() < 0.02) + (400 if 60 < k < 70 and source == 1 else 0)
                rows.append((name, inputs, source, max(0, k * 8 + rng.randrange(-2, 3)), [float(rng.randrange(1, 9)) for _ in range(n)], arrived, False))
                last = max(last, arrived)
    return [*rows, (name, inputs, 0, 0, [], last, True)]


def test_stream_of_aligned_blocks_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted(session(rng, "a") + session(rng, "b", inputs=1), key=lambda r: (r[5], r[6]))
    want = sorted(map(tuple, aligned.align(spark.createDataFrame([r for r in rows if not r[6]], CHUNK), "rec", CLOCK).collect()))
    assert sum(sum(r[7]) for r in want) and any(sum(r[9]) for r in want)
    cuts = sorted(rng.sample(range(len(rows)), 4))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], CHUNK).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
        time.sleep(0.02)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        blocks = aligned.align_stream(stream, "rec", CLOCK)
        query = blocks.writeStream.format("memory").queryName("aligned").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.set(provider, before)
    assert sorted(map(tuple, spark.table("aligned").collect())) == want


def run(pieces, seconds=20, inputs=1, clock=CLOCK):
    """Blocks and machine of pieces (source, at, arrived), 16 samples of ones each."""
    one, out = aligned.Aligner(clock, inputs), []
    for source, at, arrived in sorted(pieces, key=lambda p: (p[2], p[0], p[1])):
        out += one.arrive(source, at, np.ones(16), arrived)
    out += one.pump(seconds * 160)
    return one, out + one.finish()


def test_stalls_lose_nothing():
    # all that is made in the first 4 of every 10 seconds arrives at once after them
    pieces = [(0, at, max(at + 16, (at // 1600) * 1600 + 640)) for at in range(0, 3200, 16)]
    one, blocks = run(pieces)
    assert one.late == [0] and one.trimmed == [0] and sum(b[6][0] for b in blocks) == 0 and sum(b[3] for b in blocks) == 3200


def test_a_real_gap_is_silence_in_its_place():
    one, blocks = run([(0, at, at + 16) for at in range(0, 3200, 16) if not 800 <= at < 1120])
    x = np.concatenate([b[4] for b in blocks])
    assert (x[800:1120] == 0).all() and x.sum() == 3200 - 320 and one.late == [0]


def test_sound_held_up_too_long_is_late():
    one, blocks = run([(0, at, max(at + 16, 1600 if at >= 480 else 0)) for at in range(0, 3200, 16)])
    assert one.late[0] > 0 and sum(b[3] for b in blocks) == 3200
    assert one.late[0] == sum(b[6][0] for b in blocks)


def test_one_input_waits_for_the_other_up_to_the_bound():
    one, blocks = run([(0, at, at + 16) for at in range(0, 1600, 16)], inputs=2)
    due = {b[1]: b[2] for b in blocks}
    assert due[0] == 8 + CLOCK.hold and due[160] == 168 + CLOCK.hold


def test_counters_and_summary(spark):
    rows = [("s", 2, 0, 0, [0.5] * 160, 160), ("s", 2, 0, 320, [0.0] * 160, 480), ("s", 2, 1, 0, [0.25] * 480, 480), ("s", 2, 1, 0, [1.0] * 80, 900)]
    chunks = spark.createDataFrame(rows, "rec string, inputs int, source int, at long, pcm array<double>, arrived long")
    got = aligned.counters(chunks, "rec", CLOCK)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 2, 160, 160, 160, 0, 0, 0.5), (1, 2, 560, 0, 0, 80, 0, 1.0)]
    kind = F.when(F.col("source") == 0, "mic").otherwise("app")
    assert aligned.summary(got, "rec", kind, 160).first().summary == "input 1 (mic): 1.0 s sound, 1.0 s pure silence, 1.0 s nothing arrived; input 2 (app): 3.5 s sound, 0.0 s pure silence, 0.0 s nothing arrived"


# labels


def test_overlay_equals_a_look_at_every_moment(spark):
    rng = random.Random(2)
    rows = [(r, float(a), float(a + rng.randrange(0, 9)), f"s{rng.randrange(4)}", rng.randrange(3)) for r in range(3) for a in (rng.randrange(60) for _ in range(40))]
    held = spark.createDataFrame(rows, "rec int, start double, end double, speaker string, generation int")
    pieces = overlay.overlay(held, ["rec"])
    got = sorted(map(tuple, pieces.collect()))
    for r in range(3):
        mine = [p for p in got if p[0] == r]
        assert all(a[2] <= b[1] and (a[2] < b[1] or a[3:] != b[3:]) for a, b in zip(mine, mine[1:], strict=False))
        for t in np.arange(0, 70, 0.5):
            want = min(((g, s) for q, a, b, s, g in rows if q == r and a <= t < b), default=None)
            assert [(p[4], p[3]) for p in mine if p[1] <= t < p[2]] == ([want] if want else [])
    frames = spark.createDataFrame([(r, t / 2) for r in range(4) for t in range(140)], "rec int, t double")
    tagged = overlay.retag(frames, pieces, ["rec"]).collect()
    assert len(tagged) == 560 and len({(x.rec, x.t) for x in tagged}) == 560
    for x in tagged:
        want = min(((g, s) for q, a, b, s, g in rows if q == x.rec and a <= x.t < b), default=(None, None))
        assert (x.generation, x.speaker) == want
    assert overlay.overlay(held.where("false"), ["rec"]).count() == 0


def test_superseded_labels_go(spark):
    cols = "rec int, start double, end double, speaker string"
    grouped = spark.createDataFrame([(0, 0.0, 4.0, "a"), (0, 4.0, 10.0, "b")], cols)
    online = spark.createDataFrame([(0, 2.0, 9.0, "x"), (0, 8.0, 12.0, "y"), (0, 11.0, 13.0, "o"), (1, 1.0, 2.0, "z")], cols)
    own = spark.createDataFrame([(0, 9.5, 11.5, "o"), (0, 1.0, 2.0, "o")], cols)
    until = spark.createDataFrame([(0, 10.0)], "rec int, until double")
    held = overlay.layers(grouped, own, online, until, ["rec"])
    assert sorted(map(tuple, held.collect())) == [(0, 0.0, 4.0, "a", 0), (0, 4.0, 10.0, "b", 0), (0, 10.0, 11.5, "o", 1), (0, 10.0, 12.0, "y", 2), (1, 1.0, 2.0, "z", 2)]


# halo blocks


@pytest.fixture(scope="module")
def series(spark):
    """Two recordings in blocks of 10: 95 samples, and 47 with the third block missing."""
    rng = np.random.default_rng(3)
    x = {0: rng.normal(size=95), 1: rng.normal(size=47)}
    x[1][20:30] = 0
    rows = [(r, k, x[r][k * 10 : k * 10 + 10].tolist()) for r in x for k in range(-(-len(x[r]) // 10)) if (r, k) != (1, 2)]
    return x, spark.createDataFrame(rows, "rec int, block long, pcm array<double>")


@pytest.mark.parametrize("before, after", [(0, 0), (3, 2), (10, 10), (25, 7), (126, 0)])
def test_halo_has_what_lies_around(series, before, after):
    x, blocks = series
    for r in halo.with_halo(blocks, ["rec"], "block", "pcm", 10, before, after).collect():
        at, whole = r.block * 10, x[r.rec]
        left = min(before, at)
        stop = min(len(whole), at + 10 + after)
        if r.rec == 1 and at < 20:
            stop = min(stop, 20)  # the missing block ends it
        assert r.left == left and r.frames == min(10, len(whole) - at)
        assert np.allclose(r.pcm, whole[at - left : max(stop, at + r.frames)])


def joined(found, n):
    out = np.full(n, np.nan)
    for r in found:
        out[r.at : r.at + len(r.pcm)] = r.pcm
    return out


def test_filters_on_halos_equal_the_whole(series):
    x, blocks = series
    got = features.decimate(blocks, ["rec"], "block", 10).withColumn("at", F.ceil(F.col("block") * 10 / 3)).collect()
    for rec, whole in x.items():
        want = features.Decimator().push(whole)
        out = joined([r for r in got if r.rec == rec], len(want))
        there = ~np.isnan(out)
        assert np.allclose(out[there], want[there]) and there.sum() >= len(want) - (4 if rec else 0)
    smooth = halo.smooth(blocks.where("rec = 0"), ["rec"], "block", "pcm", 10, 12, 4).withColumn("at", F.col("block") * 10).collect()
    assert np.allclose(joined(smooth, 95), [x[0][max(0, k - 12) : k + 5].mean() for k in range(95)])


def test_voice_blocks_keep_each_centre_once(series):
    x, blocks = series

    def measure(piece):  # frames of 6 samples, 2 apart
        starts = np.arange(0, max(0, len(piece) - 5), 2)
        return (starts + 3) / 100, np.array([piece[s : s + 6].sum() for s in starts])

    got = sorted((r.t, r.value) for r in halo.voice_blocks(blocks.where("rec = 0"), ["rec"], "block", "pcm", 10, 100, measure, before=0.2, after=0.1).collect())
    centre, value = measure(x[0])
    assert np.allclose([t for t, _ in got], centre) and np.allclose([v for _, v in got], value)


@pytest.mark.parametrize("per", [1, 3, 12])
def test_windows_cover_all_and_give_each_moment_once(series, per):
    x, blocks = series
    got = halo.inference_windows(blocks, ["rec"], "block", "pcm", 10, per)
    for r in got.collect():
        want = np.zeros(per * 10)
        piece = x[r.rec][r.window * 10 :][: per * 10]
        want[: len(piece)] = piece
        assert np.allclose(r.pcm, want) and r.heard == len(piece)
    once = got.select("rec", "window", "heard", F.posexplode("pcm").alias("p", "v")).where("p < heard").withColumn("i", F.col("window") * 10 + F.col("p"))
    kept = once.where(halo.newest(F.col("window"), F.col("i"), 10, per * 10)).groupBy("rec").agg(F.count("i").alias("n"), F.countDistinct("i").alias("d")).collect()
    assert {(r.rec, r.n, r.d) for r in kept} == {(0, 95, 95), (1, 47, 47)}


# confirmation, back-fill, regrouping


def voices(rng, rounds=14):
    """(rec, round, speaker, talk, longest, first, own): voices grow, fade and come back."""
    rows = []
    for rec in range(4):
        for r in range(rounds):
            for k in range(5):
                talk = max(0.0, (r + 1) * rng.choice([0.02, 0.1, 0.6, 3.0]) * (0.1 if k == 3 and 5 < r < 11 else 1))
                if rng.random() < 0.8:
                    rows.append((rec, r, k, talk, min(talk, rng.choice([0.5, 0.9, 2.0])), k * 1.5, k == 4 and rec % 2 == 0))
    return rows


ROUND = "rec int, round int, speaker long, talk double, longest double, first double, own boolean"


def test_confirmed_speakers_in_batch_and_stream(spark, tmp_path):
    rows = voices(random.Random(8))
    got = sorted(map(tuple, confirm.confirmed(spark.createDataFrame(rows, ROUND), ["rec"]).collect()))
    for rec in range(4):
        one, want = confirm.Confirmation(), []
        for r in sorted({x[1] for x in rows if x[0] == rec}):
            want += [(rec, r, *v) for v in one.round([x[2:] for x in rows if x[:2] == (rec, r)])]
        assert [g for g in got if g[0] == rec] == sorted(want)
    for k, some in enumerate([range(0, 1), range(1, 6), range(6, 14)]):
        spark.createDataFrame([r for r in rows if r[1] in some], ROUND).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
        time.sleep(0.02)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ROUND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = confirm.confirmed_stream(stream, "rec").writeStream.format("memory").queryName("confirmed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.set(provider, before)
    assert sorted(map(tuple, spark.table("confirmed").collect())) == got


def test_a_voice_is_confirmed_and_dropped():
    one = confirm.Confirmation()
    main = (0, 50.0, 5.0, 0.0, False)
    assert one.round([main]) == [(0, 0, 0)]  # the first needs one round
    assert one.round([main, (1, 3.0, 1.0, 4.0, False)]) == [(0, 0, 0)]
    assert one.round([main, (1, 3.0, 1.0, 4.0, False)]) == [(0, 0, 0), (1, 1, 1)]
    assert one.round([main, (1, 3.0, 1.0, 4.0, False), (2, 0.1, 0.9, 9.0, True)])[-1] == (2, 2, 2)  # an input of their own
    weak = [main, (1, 0.5, 0.5, 4.0, False), (2, 0.1, 0.9, 9.0, True)]
    assert one.round(weak) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    assert one.round(weak) == [(0, 0, 0), (2, 2, 1)]  # dropped, and the gap in the numbers closed
    strong = [main, (1, 9.0, 2.0, 4.0, False), (2, 0.1, 0.9, 9.0, True)]
    assert one.round(strong) == [(0, 0, 0), (2, 2, 1), (1, 3, 2)]


def test_backlog_goes_oldest_first_two_at_a_time(spark):
    rows = [(0, c, c in (2, 3, 4, 7, 9, 10)) for c in range(12)] + [(1, 0, True), (2, 5, False)]
    df = spark.createDataFrame(rows, "rec int, chunk long, lacks boolean")
    got = sorted(map(tuple, confirm.backlog(df, ["rec"], F.col("lacks")).collect()))
    assert got == [(0, 2, 0), (0, 3, 0), (0, 4, 1), (0, 7, 2), (0, 9, 3), (0, 10, 3), (1, 0, 0)]


def test_solo_speaker(spark):
    grouped = spark.createDataFrame([(0, 0.0, 5.0, 3), (0, 6.0, 8.0, 1), (0, 9.0, 12.0, 1)], "rec int, start double, end double, speaker int")
    known = spark.createDataFrame([(0, 3), (0, 1), (1, 4), (2, None)], "rec int, speaker int")
    assert sorted(map(tuple, confirm.solo(grouped, ["rec"], known).collect())) == [(0, 1), (1, 5), (2, 0)]


def test_regroupings_are_whole_spaced_and_final(spark, tmp_path):
    now, runs = [0.0], []

    def group(seen):
        runs.append(now[0])
        now[0] += 6.0  # how long a regrouping takes
        return seen.groupBy("v").count()

    one = regroup.Regrouper(str(tmp_path / "out"), group, lambda seen: float(seen.count()), clock=lambda: now[0])

    def add(number, gap):
        now[0] += gap
        one.batch(spark.createDataFrame([(number, number % 2)], "id long, v long"), number)
        return {r.v: r["count"] for r in regroup.current(spark, str(tmp_path / "out")).collect()}

    assert add(0, 0) == {0: 1}
    assert add(1, 3) == {0: 1} and add(2, 2.9) == {0: 1}  # not before as long as it took
    before = regroup.current(spark, str(tmp_path / "out"))
    assert add(3, 0.2) == {0: 2, 1: 2} and regroup.state(spark, str(tmp_path / "out"))["until"] == 4.0
    assert before.count() == 1  # who reads the version before still can
    one.ask()
    assert add(3, 0) == {0: 2, 1: 2}  # a repeated batch replaces itself
    add(4, 1)
    for number in range(5, 7):
        spark.createDataFrame([(number, 0)], "id long, v long").coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    stream = spark.readStream.schema("id long, v long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    other = regroup.Regrouper(str(tmp_path / "out2"), group, lambda seen: float(seen.count()), clock=lambda: now[0])
    other.finish(other.start(stream, str(tmp_path / "check")))
    assert {r.v: r["count"] for r in regroup.current(spark, str(tmp_path / "out2")).collect()} == {0: 2}
    assert sorted(p.name for p in (tmp_path / "out/labels").iterdir()) == ["version=1", "version=2"]


def test_levels_of_a_stream_equal_the_whole(spark, tmp_path):
    x = np.random.default_rng(5).normal(0, 0.2, 1037)
    cuts = [0, 3, 10, 11, 250, 251, 999, 1037]
    schema = "rec string, k long, pcm array<double>"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame([("r", k, x[a:b].tolist())], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = live.hop_levels(stream, "rec", "k", "pcm", 20).writeStream.format("memory").queryName("hops").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = {r.i: r.db for r in spark.table("hops").collect()}
    want = [20 * np.log10(np.sqrt((x[k * 20 : k * 20 + 20] ** 2).mean())) for k in range(51)]
    assert sorted(got) == list(range(51)) and np.allclose([got[k] for k in range(51)], want)


def test_frames_of_a_home_input_or_primary_ones(spark):
    rows = [(0, t, s, v) for t, loud in ((0.0, (0.5, 0.9)), (0.1, (0.7, 0.7)), (0.2, (None, float("nan"))), (0.3, (float("nan"), 0.1))) for s, v in enumerate(loud)]
    frames = live.primary(spark.createDataFrame(rows, "rec int, t double, src int, loudness double"), ["rec"])
    assert sorted((r.t, r.src) for r in frames.where("prim").collect()) == [(0.0, 1), (0.1, 0), (0.2, 0), (0.3, 1)]
    homes = spark.createDataFrame([(0, "a", 0), (0, "b", None)], "rec int, speaker string, home int")
    got = live.frames_of(frames, homes, ["rec"]).collect()
    assert sorted((r.t, r.src) for r in got if r.speaker == "a") == [(0.0, 0), (0.1, 0), (0.2, 0), (0.3, 0)]
    assert sorted((r.t, r.src) for r in got if r.speaker == "b") == [(0.0, 1), (0.1, 0), (0.2, 0), (0.3, 1)]


def test_recordings_that_cannot_be_analysed(spark):
    df = spark.createDataFrame([(0, 0.99, None), (1, 1.0, 20), (2, 5.0, 21), (3, 5.0, 0), (4, None, 2)], "rec int, duration double, num_speakers int")
    assert {r.rec: r.error for r in live.checked(df).collect()} == {0: "shorter than 1 s", 1: None, 2: "the number of speakers is from 1 to 20", 3: "the number of speakers is from 1 to 20", 4: "shorter than 1 s"}


def test_windows_of_a_stream_equal_batch_and_give_each_sample_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = {"a": rng.normal(size=97), "b": rng.normal(size=25), "c": rng.normal(size=40)}
    schema = "rec string, block long, pcm array<double>, ended boolean"
    rows = [(r, k, v[k * 10 : k * 10 + 10].tolist(), False) for r, v in x.items() for k in range(-(-len(v) // 10))]
    want = halo.inference_windows(spark.createDataFrame(rows, schema), ["rec"], "block", "pcm", 10, 4)
    want = sorted((r.rec, r.window, r.pcm, r.heard) for r in want.collect())
    rows = sorted(rows, key=lambda r: r[1]) + [(r, 99, [], True) for r in x]
    for k, (a, b) in enumerate(((0, 4), (4, 5), (5, 13), (13, len(rows)))):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.02)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = windows.windows_stream(stream, "rec", 10, 4).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.set(provider, before)
    got = spark.table("windows").orderBy("rec", "window").collect()
    assert [(r.rec, r.window, r.pcm, r.heard) for r in got] == want
    for rec, whole in x.items():
        assert np.allclose(np.concatenate([r.pcm[r.heard - r.fresh : r.heard] for r in got if r.rec == rec]), whole)
