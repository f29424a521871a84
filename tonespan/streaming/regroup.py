"""Regrouping a live session now and then: labels in versions that readers see whole."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Fixed value: least seconds between regroupings.
EVERY = 4.0
#: Versions of the labels that stay for those who are still reading them.
KEPT = 2


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file beside its place and move it there in one step."""
    jvm, where, fs = _files(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    rename = spark.sparkContext._gateway.new_array(kind, 1)
    rename[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, where, rename)


def state(spark: SparkSession, path: str) -> dict | None:
    """The pointer: the version that holds, how far it has seen, when and how long it took."""
    _, where, fs = _files(spark, f"{path}/current")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The labels of the last whole regrouping; None before the first."""
    now = state(spark, path)
    return None if now is None else spark.read.parquet(f"{path}/labels/version={now['version']}")


class Regrouper:
    """Adds each batch to what was seen and regroups all of it at most every ``every``
    seconds, or as long as the last regrouping took if that is more; at once if asked, and
    once more at the end. A batch costs what it brings; between regroupings its new windows
    are labelled online and laid over the version that holds (``overlay.layers``)."""

    def __init__(self, path: str, group: Callable[[DataFrame], DataFrame], until: Callable[[DataFrame], float], every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.path, self.group, self.until, self.every, self.clock = path, group, until, every, clock
        self.last: float | None = None
        self.took = 0.0
        self.asked = False

    def ask(self) -> None:
        """Regroup with the next batch."""
        self.asked = True

    def due(self) -> bool:
        return self.asked or self.last is None or self.clock() - self.last >= max(self.every, self.took)

    def batch(self, rows: DataFrame, number: int) -> None:
        """A step of a stream; a batch that is repeated replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.path}/seen/batch={number}")
        if self.due():
            self.regroup(rows.sparkSession)

    def regroup(self, spark: SparkSession) -> None:
        _, where, fs = _files(spark, f"{self.path}/seen")
        if not fs.exists(where):
            return
        began = self.clock()
        self.asked = False
        seen = spark.read.parquet(f"{self.path}/seen").drop("batch")
        version = (state(spark, self.path) or {"version": -1})["version"] + 1
        # a version that was begun and never named is written anew
        self.group(seen).write.mode("overwrite").parquet(f"{self.path}/labels/version={version}")
        self.last, self.took = self.clock(), self.clock() - began
        _replace(spark, f"{self.path}/current", {"version": version, "until": self.until(seen), "took": self.took})
        jvm, _, fs = _files(spark, self.path)
        if version >= KEPT:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/labels/version={version - KEPT}"), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def finish(self, query: StreamingQuery) -> None:
        """Wait for the stream's end, then regroup all of it for the last time."""
        query.awaitTermination()
        self.regroup(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active())
