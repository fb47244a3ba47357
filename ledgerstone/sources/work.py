"""Work tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, the default one's if it names none, so that executors open the same place as Spark does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/ledgerstone-shared-{os.getuid()}"
    return qualified(spark, found.rstrip("/"))


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerstone/{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def top_entries(spark: SparkSession, root: str) -> DataFrame:
    """name, folder (whether it is one) of what stands at the top of root, dealt over several tasks a core."""
    top = qualified(spark, root)

    def listed(batches):
        for batch in batches:
            if len(batch):
                fs, base = pafs.FileSystem.from_uri(top)
                found = fs.get_file_info(pafs.FileSelector(base))
                yield pa.record_batch([pa.array([i.base_name for i in found], pa.string()), pa.array([i.type == pafs.FileType.Directory for i in found], pa.bool_())], names=["name", "folder"])

    return spark.range(0, 1, 1, 1).mapInArrow(listed, "name string, folder boolean").repartition(16 * spark.sparkContext.defaultParallelism)


def remove_spread(spark: SparkSession, root: str) -> None:
    """remove() of a work folder with many files: tasks remove what its folders hold."""
    top = qualified(spark, root)

    def gone(batches):
        fs, base = pafs.FileSystem.from_uri(top)
        for batch in batches:
            for name in batch["name"].to_pylist():
                fs.delete_dir(f"{base}/{name}")
            yield batch

    top_entries(spark, root).filter("folder").mapInArrow(gone, "name string, folder boolean").write.format("noop").mode("overwrite").save()
    remove(spark, root)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.ledgerstone_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes the shuffle files of plans that nothing refers to any more. It takes two rounds: the first lets go of what the plans held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def dealt(rows: DataFrame) -> DataFrame:
    """A table over all cores: one with fewer splits than there are cores, as one small file has, is dealt over them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def drop(df: DataFrame) -> None:
    """Delete what materialise() wrote; only for tables that nothing lazy still reads."""
    remove(df.sparkSession, df.ledgerstone_path)
