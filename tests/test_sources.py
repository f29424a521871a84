"""Readers and writers."""

import json
import struct
import wave

import pytest

from tonespan.functions import signal
from tonespan.sources import audio, store


def write_wav(path, channels, rate=16_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack(f"<{len(channels)}h", *frame) for frame in zip(*channels, strict=True)))


def test_wav_is_decoded_and_mixed_down(spark, tmp_path):
    write_wav(tmp_path / "a.wav", [[0, 16384, -32768], [0, 0, 0]])
    (tmp_path / "b.wav").write_bytes(b"not a recording")
    rows = audio.read(spark, str(tmp_path / "*.wav")).collect()
    samples = sorted((r.i, r.x) for r in rows if r.error is None)
    assert samples == [(0, 0.0), (1, 0.25), (2, -0.5)]
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["b.wav"]


def test_first_seconds_only(spark, tmp_path):
    write_wav(tmp_path / "a.wav", [list(range(100))], rate=50)
    assert audio.read(spark, str(tmp_path / "a.wav"), seconds=1.0, rate=50).count() == 50


def test_resampling_keeps_the_duration(spark, tmp_path):
    write_wav(tmp_path / "a.wav", [[1000] * 480], rate=48_000)
    rows = audio.read(spark, str(tmp_path / "a.wav")).collect()
    assert len(rows) == 160 and all(r.x == pytest.approx(1000 / 32768) for r in rows)


def test_jobs_tolerate_bad_json(spark, tmp_path):
    for name, text in (("a", {"id": "a", "input_file": "x.wav", "created": 2.0}), ("b", {"id": "b", "input_file": "y.wav", "status": "done"}), ("c", {"id": "c"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(json.dumps(text))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "job.json").write_text("{not json")
    assert {r.id: r.status for r in store.read_jobs(spark, f"{tmp_path}/*/job.json").collect()} == {"a": "error", "b": "done"}


def test_segments_and_partitions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 0.5), ("b", 3.0, 4.0)], "rec string, start double, end double")
    store.write_segments(df, "rec", str(tmp_path / "json"))
    assert {r.rec: json.loads(r.segments) for r in spark.read.json(str(tmp_path / "json")).collect()}["a"] == [{"start": 0.0, "end": 0.5}, {"start": 1.0, "end": 2.0}]
    store.save(df, str(tmp_path / "t"), "rec")
    store.save(df.where("rec = 'a'").limit(1), str(tmp_path / "t"), "rec")
    assert {r.rec: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("rec").count().collect()} == {"a": 1, "b": 1}


def test_programs(spark):
    df = spark.createDataFrame([("b.exe", False), ("a.exe", False), ("b.exe", True), ("h.exe", True)], "exe string, playing boolean")
    hidden = spark.createDataFrame([("h.exe",)], "exe string")
    assert [(r.exe, r.playing) for r in store.programs(df, hidden).collect()] == [("b.exe", True), ("a.exe", False)]


def test_names_and_keys(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        signal.safe_name(F.lit("a/b:c é_-"), F.lit(0)).alias("a"), signal.safe_name(F.lit("//"), F.lit(1)).alias("b"), signal.without_extension(F.lit("x.y.mp3")).alias("c"),
        signal.output_key(F.lit(-30), F.lit(True), F.lit(4)).alias("d"), signal.clock(F.lit(125.9)).alias("e"), signal.to_16bit(F.lit(2.0)).alias("f"), signal.closest_frame(F.lit(0.5 * 0.0619375 + 0.016875 * 3)).alias("g"),
    ).first()
    assert tuple(row) == ("abc é_-", "speaker 2", "x.y", "-30-speech4", "2:05", 32767 / 32768, 3)


def test_ticks_and_texts(spark):
    from pyspark.sql import functions as F

    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(signal.ticks(F.lit(0.0), F.lit(10.0), 600)) == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert one(signal.ticks(F.lit(12.3), F.lit(13.1), 330)) == [12.5, 13.0]
    assert one(signal.ticks(F.lit(0.0), F.lit(90_000.0), 100))[:2] == [0.0, 3600.0]
    row = spark.range(1).select(signal.hertz(F.lit(120.5)), signal.decibel_text(F.lit(-3.26)), signal.full_clock(F.lit(59.6)), signal.full_clock(F.lit(3725.2)), signal.stamp_text(F.lit(86_460.0))).first()
    assert tuple(row) == ("120 Hz", "-3.3 dB", "1:00", "1:02:05", "1970-01-02 00:01")


def test_voice_frames_with_and_without_inputs(spark, tmp_path):
    plain = spark.createDataFrame([("a", 0.5, 1.0)], "rec string, t double, f0 double")
    store.save(plain, str(tmp_path / "p"), "rec")
    store.save(plain.selectExpr("*", "2 as src", "false as prim"), str(tmp_path / "i"), "rec")
    assert [(r.src, r.prim) for r in store.voice_frames(spark, str(tmp_path / "p")).collect()] == [(None, True)]
    assert [(r.src, r.prim) for r in store.voice_frames(spark, str(tmp_path / "i")).collect()] == [(2, False)]


def test_first_seconds_of_every_track(spark):
    rows = [(k, b, [float(b * 4 + i) for i in range(4 if b < 2 else 1)]) for k in range(2) for b in range(3)]
    df = spark.createDataFrame(rows, "track int, block long, pcm array<double>")
    got = store.first_seconds(df, 4, 2, 3.0).orderBy("track", "block").collect()
    assert [(r.track, r.block, r.pcm) for r in got] == [(k, b, x) for k in range(2) for b, x in ((0, [0.0, 1.0, 2.0, 3.0]), (1, [4.0, 5.0]))]
