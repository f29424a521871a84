"""Recordings as Spark data sources: live feeds read as they grow, and files of sound that
appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tonespan.sources import matroska
from tonespan.streaming.scan import scan

#: Frames of a row, and bytes that one task reads.
FRAMES, PART_BYTES = 800, 16 << 20


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a location; a plain path is local."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


# live feeds


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class _FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.channels = options["path"], int(options["channels"])
        self.frame = 4 * self.channels
        self.part = max(1, int(options.get("partbytes", PART_BYTES)) // (self.frame * FRAMES)) * self.frame * FRAMES

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole frames that each feed has so far."""
        fs, path = _place(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size // self.frame * self.frame for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.extension == "f32"}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        _, path = _place(self.path)
        out = []
        for name, stop in end.items():
            for at in range(start.get(name, 0), stop, self.part):
                out.append(_Range(f"{self.path.rstrip('/')}/{name}", at, min(stop, at + self.part)))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, path = _place(partition.path)
        name = path.rsplit("/", 1)[-1].removesuffix(".f32")
        with fs.open_input_file(path) as file:
            for at in range(partition.start, partition.stop, self.frame * FRAMES):
                raw = file.read_at(min(self.frame * FRAMES, partition.stop - at), at)
                x = np.frombuffer(raw, "<f4").reshape(-1, self.channels)
                x = np.clip(np.rint(x.astype(np.float64) * 32768), -32768, 32767) / 32768
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // self.frame], pa.int64()), pa.array([x[:, 0].tolist()], pa.list_(pa.float32())), pa.array([x[:, 1:].T.tolist()], pa.list_(pa.list_(pa.float32())))], ["rec", "at", "mix", "inputs"])

    def commit(self, end: dict) -> None:
        pass


class Feed(DataSource):
    """Feeds of interleaved 32-bit floats, the mix and then each input, in files ``*.f32`` of
    a folder that grow while they are read: rows (rec, at, mix, inputs) of up to FRAMES
    frames, rounded to 16 bits. Options: path, channels, partbytes."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "rec string, at long, mix array<float>, inputs array<array<float>>"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FeedReader(self.options)


class _Paced:
    """A feed that keeps pace with the clock: silence wherever it is over 50 ms behind."""

    def __init__(self, rate: int):
        self.rate, self.sent = rate, 0

    def step(self, clock: float, pcm) -> list[tuple]:
        if pcm is not None:
            at, self.sent = self.sent, self.sent + len(pcm)
            return [(at, len(pcm), np.asarray(pcm, float).tolist())]
        due = int(clock * self.rate)
        if due - self.sent <= self.rate // 20:
            return []
        at, self.sent = self.sent, due
        return [(at, due - at, None)]

    def end(self) -> list[tuple]:
        return []


def keep_time(rows: DataFrame, key: str, rate: int) -> DataFrame:
    """(key, at, frames, pcm) of (key, clock, pcm): pieces of a program's sound go on one
    behind the other; at a row without sound (a tick of the clock) a feed that is more than
    a twentieth of a second behind gets silence (null) up to now."""
    return scan(rows, [key], ["clock"], ["clock", "pcm"], lambda _: _Paced(rate), "at long, frames long, pcm array<double>")


# files of sound


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # as written, as named


class _TrackWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rate = options["path"].rstrip("/"), int(options["rate"])
        self.names, self.kind = json.loads(options["names"]), matroska.WaveFile if options.get("format") == "wav" else matroska.MatroskaFile
        self.work = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        fs, work = _place(self.work)
        fs.create_dir(work)
        out, now, file = [], None, None
        for row in iterator:
            if row["rec"] != now or file is None:
                if file is not None:
                    file.close()
                now = row["rec"]
                # a second attempt of this task gets a name of its own
                written = f"{work}/{uuid.uuid4().hex}"
                file = self.kind(fs.open_output_stream(written), self.names, self.rate)
                out.append((written, f"{now}.{self.kind.suffix}"))
            file.write([np.asarray(x, np.float64) for x in row["tracks"]])
        if file is not None:
            file.close()
        return _Written(out)

    def commit(self, messages: list) -> None:
        fs, path = _place(self.path)
        for m in messages:
            for written, name in m.files if m is not None else []:
                fs.move(written, f"{path}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, work = _place(self.work)
        if fs.get_file_info(work).type != pa.fs.FileType.NotFound:
            fs.delete_dir(work)


class Tracks(DataSource):
    """One file for each recording, of rows (rec string, at long, tracks array<array>) in
    order of ``at`` and with a recording's rows in one task. Files are written beside and
    moved to their names when all tasks have ended well; what failed leaves nothing.
    Options: path, rate, names (JSON list, a name for each track), format (mka or wav)."""

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TrackWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats "feed" and "tracks" known to a session."""
    for source in (Feed, Tracks):
        spark.dataSource.register(source)


def write_tracks(rows: DataFrame, path: str, names: list[str], rate: int, format: str = "mka") -> None:
    """Files of (rec, at, tracks); each recording streams through one task."""
    register(rows.sparkSession)
    ordered = rows.select(F.col("rec").cast("string").alias("rec"), F.col("at").cast("long").alias("at"), F.col("tracks").cast("array<array<double>>").alias("tracks")).repartition("rec").sortWithinPartitions("rec", "at")
    ordered.write.format("tracks").option("path", path).option("rate", rate).option("names", json.dumps(names)).option("format", format).mode("append").save()


def live_encode(blocks: DataFrame, path: str, names: list[str], rate: int, key: str = "rec") -> None:
    """A file for each session of aligned blocks: the mix as track 0, then each input."""
    tracks = F.concat(F.array("mix"), F.col("inputs"))
    write_tracks(blocks.select(F.col(key).alias("rec"), "at", tracks.alias("tracks")), path, ["Mix", *names], rate)


def cut_blocks(blocks: DataFrame, segments: DataFrame, keys: list[str], index: str, pcm: str, size: int, rate: int) -> DataFrame:
    """(keys, at, pcm): what the segments (keys, start, end) keep of blocks of ``size``
    samples, ``at`` its place once all are joined. Bounds are truncated to whole samples;
    segments find their blocks by number, so only those move."""
    from tonespan.operators import timeline

    whole = timeline.offsets(segments.select(*keys, F.floor(F.col("start") * rate).alias("start"), F.floor(F.col("end") * rate).alias("end")), keys).where("end > start")
    wanted = whole.select(*keys, "start", "end", "offset", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias(index))
    found = blocks.select(*keys, F.col(index).cast("long").alias(index), pcm).join(wanted, [*keys, index])
    first = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col(index) * size)
    n = F.least(F.size(pcm).cast("long"), F.col("end") - F.col(index) * size) - first
    return found.where(n > 0).select(*keys, (F.col("offset") + F.col(index) * size + first - F.col("start")).cast("long").alias("at"), F.slice(pcm, (first + 1).cast("int"), n.cast("int")).alias("pcm"))


def render(blocks: DataFrame, segments: DataFrame, path: str, size: int, rate: int, format: str = "wav", index: str = "block", pcm: str = "pcm", key: str = "rec") -> DataFrame:
    """Write each recording's segments, joined, to a file; returns (key, duration)."""
    pieces = cut_blocks(blocks, segments, [key], index, pcm, size, rate)
    write_tracks(pieces.select(F.col(key).alias("rec"), "at", F.array("pcm").alias("tracks")), path, [""], rate, format)
    return pieces.groupBy(key).agg((F.sum(F.size("pcm")) / rate).alias("duration"))


def audio_streams(spark: SparkSession, path: str) -> DataFrame:
    """(path, stream, title, error) of each audio stream of the files at ``path``, from
    their headers; title "" if there is none, one row with the error for a file that is no
    known container."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(name, k, title, None) for k, title in enumerate(matroska.titles(bytes(content)))]
                except (ValueError, IndexError) as e:
                    out.append((name, -1, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "stream", "title", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, stream int, title string, error string")


def mono(x: Column) -> Column:
    """Mean of the inputs of each frame (a mono downmix of channels as arrays)."""
    n = F.size(x)
    zipped = F.aggregate(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.element_at(x, 1), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return F.transform(zipped, lambda v: v / n)
