"""Cutting the lineage of small results that later steps read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the checkpoint folder that all executors share;
    ``df`` as it is where no such folder is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
