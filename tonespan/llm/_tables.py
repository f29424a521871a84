"""Shared-folder tables, table reading and small helpers used by every operator here."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint folder.

    It comes from ``spark.checkpoint.dir``. Without that setting a session of one process
    (a test) gets a temporary folder of its own; on a cluster that is an error, as other
    executors would not see what one has written.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


class Shared(str):
    """Path of a table written below the shared folder."""


def write_shared(df: DataFrame, name: str, partition_by: list[str] | None = None) -> Shared:
    path = Shared(f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    path = write_shared(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, part: str | None = None) -> DataFrame:
    """The rows written to a table below the shared folder, dealt into buckets by ``key``:
    joins on it move the other side alone. As many buckets as the plan's scan has parts,
    within what Spark allows; a part writes a file only for the buckets it has rows of. With
    ``part`` the table has a folder for each value of that column."""
    spark = df.sparkSession
    parts = min(10_000, max(1, df.select(F.lit(1)).rdd.getNumPartitions()))
    table_name = f"{name}_{uuid.uuid4().hex}"
    location = f"{shared_dir(spark)}/{table_name}"
    writer = df.write.option("path", location).bucketBy(parts, key).sortBy(key)
    (writer.partitionBy(part) if part else writer).saveAsTable(table_name)
    out = spark.table(table_name)
    out.table_name, out.location = table_name, location
    return out


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete staged and bucketed tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "table_name"):
            # the files of a table that has a place of its own stay when it goes
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.table_name}")
            drop_shared(t.sparkSession, t.location)
        else:
            drop_shared(t.sparkSession, t.shared_path)


def release(spark: SparkSession) -> None:
    """Let the context drop shuffle files of plans that are no longer referenced. The last
    plan stays referenced until another one has run, so an empty one runs first."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    for wait in (0.2, 0.2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
