"""Live feeds as a stream, files of sound written whole or not at all, stream titles."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonespan.sources import audio, matroska, recordings
from tonespan.streaming import aligned


def feed(path, x, mode="ab"):
    with open(path, mode) as f:
        f.write(x.astype("<f4").tobytes())


def test_feed_restarts_without_loss_or_repeats(spark, tmp_path):
    recordings.register(spark)
    rng = np.random.default_rng(0)
    x = {n: rng.uniform(-1.2, 1.2, (5000, 3)) for n in ("a", "b")}
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds/notes.txt").write_text("not a feed")

    def advance():
        stream = spark.readStream.format("feed").option("path", str(tmp_path / "feeds")).option("channels", 3).option("partbytes", 20_000).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        assert query.awaitTermination(120)

    at = {"a": 0, "b": 0}
    for cuts in ({"a": 1700, "b": 0}, {"a": 1701, "b": 4000}, {"a": 5000, "b": 5000}):
        for name, to in cuts.items():
            raw = x[name].astype("<f4").tobytes()
            # a frame may be half written: it waits
            with open(tmp_path / f"feeds/{name}.f32", "wb") as f:
                f.write(raw[: to * 12 + (5 if to < 5000 else 0)])
            at[name] = to
        advance()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("rec", "at").collect()
    for name, whole in x.items():
        mine = [r for r in rows if r.rec == name]
        want = np.clip(np.rint(whole.astype("<f4").astype(float) * 32768), -32768, 32767) / 32768
        assert np.allclose(np.concatenate([r.mix for r in mine]), want[:, 0], atol=1e-7)
        assert np.allclose(np.concatenate([np.array(r.inputs) for r in mine], axis=1), want[:, 1:].T, atol=1e-7)
        assert [r.at for r in mine] == list(np.cumsum([0, *[len(r.mix) for r in mine[:-1]]]))


def test_quiet_program_keeps_time(spark):
    rows = [("p", 0.1, [1.0] * 10), ("p", 0.12, None), ("p", 0.5, None), ("p", 0.6, [2.0] * 5), ("p", 0.61, None), ("q", 0.2, None)]
    got = recordings.keep_time(spark.createDataFrame(rows, "rec string, clock double, pcm array<double>"), "rec", 100).collect()
    # up to 50 ms behind is no gap; the sound at 0.6 s goes straight on and is overtaken at the next tick
    assert sorted((r.rec, r.at, r.frames, r.pcm is None) for r in got) == [("p", 0, 10, False), ("p", 10, 40, True), ("p", 50, 5, False), ("p", 55, 6, True), ("q", 0, 20, True)]


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(1)
    x = {r: np.rint(rng.uniform(-1, 1, n) * 32767) / 32768 for r, n in (("a", 950), ("b", 320))}
    return x, spark.createDataFrame([(r, k, v[k * 100 : k * 100 + 100].tolist()) for r, v in x.items() for k in range(-(-len(v) // 100))], "rec string, block long, pcm array<double>")


@pytest.mark.parametrize("format", ["wav", "mka"])
def test_rendered_segments_equal_slices(spark, blocks, tmp_path, format):
    x, rows = blocks
    segments = {"a": [(0.017, 0.9), (1.25, 1.25), (2.0, 5.5051), (9.0, 20.0)], "b": [(k / 100, k / 100 + 0.005) for k in range(300)]}
    df = spark.createDataFrame([(r, a, b) for r, s in segments.items() for a, b in s], "rec string, start double, end double")
    durations = {r.rec: r.duration for r in recordings.render(rows, df, str(tmp_path / "out"), 100, 100, format).collect()}
    for rec, spans in segments.items():
        want = np.concatenate([x[rec][int(a * 100) : int(b * 100)] for a, b in spans])
        content = (tmp_path / f"out/{rec}.{format}").read_bytes()
        got, rate = matroska.decode(content) if format == "mka" else audio.decode_wav(content)
        assert rate == 100 and np.allclose(got[:, 0], want) and durations[rec] == pytest.approx(len(want) / 100)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == [f"a.{format}", f"b.{format}"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(6).select(F.lit("a").alias("rec"), F.col("id").alias("at"), F.array(F.array(F.when(F.col("id") < 5, 0.5).otherwise(F.raise_error(F.lit("stopped"))))).alias("tracks"))
    with pytest.raises(Exception):
        recordings.write_tracks(bad, str(tmp_path / "out"), ["x"], 100)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_live_sessions_become_named_tracks(spark, tmp_path):
    clock = aligned.Clock(rate=160)
    rows = [("s", 2, k, at, [0.25 * (k + 1)] * 16, at + 20) for k in range(2) for at in range(0, 320, 16)]
    chunks = spark.createDataFrame(rows, "rec string, inputs int, source int, at long, pcm array<double>, arrived long")
    recordings.live_encode(aligned.align(chunks, "rec", clock), str(tmp_path), ["Ann", "Bob's mic"], 160)
    content = (tmp_path / "s.mka").read_bytes()
    for stream, level in ((0, 0.75), (1, 0.25), (2, 0.5)):
        x, rate = matroska.decode(content, stream)
        assert rate == 160 and len(x) == 320 and np.allclose(x, level)
    second = audio.read(spark, str(tmp_path / "s.mka"), rate=160, seconds=1.0, stream=2).collect()
    assert len(second) == 160 and {r.x for r in second} == {0.5}
    assert audio.read(spark, str(tmp_path / "s.mka"), stream=3).first().error
    got = recordings.audio_streams(spark, str(tmp_path / "s.mka")).orderBy("stream").collect()
    assert [(r.stream, r.title) for r in got] == [(0, "Mix"), (1, "Ann"), (2, "Bob's mic")]


def box(kind, *payload):
    body = b"".join(payload)
    return struct.pack(">I", 8 + len(body)) + kind + body


def trak(kind, handler, name=None):
    hdlr = box(b"hdlr", bytes(8), kind, bytes(12), handler + b"\0")
    return box(b"trak", box(b"tkhd", bytes(20)), box(b"mdia", box(b"mdhd", bytes(8)), hdlr), *([box(b"udta", box(b"name", name))] if name else []))


def test_stream_titles(spark, tmp_path):
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(100), f.writeframes(b"\0\0")
    files = {
        "none.mp4": box(b"ftyp", b"isom") + box(b"moov", trak(b"vide", b"VideoHandler")),
        "one.m4a": box(b"ftyp", b"M4A ") + box(b"mdat", bytes(50)) + box(b"moov", trak(b"soun", b"SoundHandler")),
        "three.m4a": box(b"ftyp", b"M4A ") + box(b"moov", trak(b"soun", b"Mix"), trak(b"vide", b"x"), trak(b"soun", b"SoundHandler", "Zoë".encode()), trak(b"soun", b"Core Media Audio")),
        "plain.wav": w.getvalue(),
        "bad.m4a": b"not a recording",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in recordings.audio_streams(spark, str(tmp_path)).orderBy("stream").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.title if r.error is None else r.error)
    assert got == {"one.m4a": [""], "three.m4a": ["Mix", "Zoë", ""], "plain.wav": [""], "bad.m4a": ["not a known audio container"]}


def test_mono_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 0.0]],), ([[1.0, 2.0]],)], "x array<array<double>>")
    assert [r.m for r in df.select(recordings.mono(F.col("x")).alias("m")).collect()] == [[3.0, 2.0], [1.0, 2.0]]
