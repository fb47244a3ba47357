"""Shared plumbing of the training-data operators: tables, the shared work folder, pickling."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..sources.work import drop, materialise, remove, settle, shared_dir, work_path

__all__ = ["drop", "materialise", "pieces", "remove", "settle", "shared_dir", "table", "work_path"]

# Functions that run on executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def pieces(batches, rows=1000):
    """Record batches cut into slices of so many rows: texts of no more rows than that are Python strings at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One with fewer splits than there are cores, as one small file has, is dealt over all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
