"""The stored library: job files, saved tables, segment files and program lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "id string, name string, created double, sha256 string, input_file string, duration double, threshold int, speech_only boolean, num_speakers int, rev int, status string"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from JSON files, one each. Files that are not JSON, or have no id or input file,
    are left out; a job that was not done when it was written has the status "error"."""
    text = spark.read.text(path, wholetext=True)
    job = text.select(F.from_json("value", JOB, {"mode": "PERMISSIVE"}).alias("job")).select("job.*")
    known = job.where("id is not null and input_file is not null")
    return known.withColumn("status", F.when(F.col("status") == "done", "done").otherwise("error"))


def watch_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: recordings that appear are read within a trigger."""
    text = spark.readStream.option("wholetext", True).text(path)
    return text.select(F.from_json("value", JOB, {"mode": "PERMISSIVE"}).alias("job")).select("job.*").where("id is not null and input_file is not null")


def save(df: DataFrame, path: str, *keys: str) -> None:
    """Write a table partitioned by recording, replacing only the recordings in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_segments(segments: DataFrame, key: str, path: str) -> None:
    """One JSON line for each recording: its segments in order."""
    listed = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("segments"))
    listed.select(key, F.to_json("segments").alias("segments")).write.mode("overwrite").json(path)


def programs(found: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row for each program, playing if any of its processes is; playing ones first."""
    shown = found.join(hidden, "exe", "left_anti").groupBy("exe").agg(F.bool_or("playing").alias("playing"))
    return shown.orderBy(F.desc("playing"), F.lower("exe"))


def shifted(frames: DataFrame, offset: float) -> DataFrame:
    """Live frames on the clock of the recording that is kept."""
    return frames.withColumn("t", F.col("t") + offset)


def voice_frames(spark: SparkSession, path: str) -> DataFrame:
    """Saved voice frames with ``src`` and ``prim``, the input that each was measured on and
    whether it was the loudest then; frames saved without inputs are all of input null and
    count everywhere."""
    saved = spark.read.parquet(path)
    if "src" in saved.columns:
        return saved
    return saved.withColumns({"src": F.lit(None).cast("int"), "prim": F.lit(True)})


def first_seconds(blocks: DataFrame, size: int, rate: int, seconds: float, index: str = "block", pcm: str = "pcm") -> DataFrame:
    """The first ``seconds`` of every recording or track of blocks of ``size`` samples: whole
    blocks are kept as they are, the one that the end falls into is cut."""
    last = int(seconds * rate)
    left = F.lit(last) - F.col(index) * size
    kept = blocks.where(left > 0)
    return kept.withColumn(pcm, F.slice(pcm, 1, F.least(left, F.size(pcm)).cast("int")))
