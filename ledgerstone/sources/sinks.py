"""Sinks of an audit: registry CSV, evidence as JSON lines, chunks, raw copies with a manifest, direct subset, summaries, report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Quota
from ..functions.text import as_json, flatten
from ..operators.summary import quality_summary, report, summary
from ..schemas import REGISTRY
from .work import qualified, remove

# The columns of the CSV in their order, and how many rows a chunk has.
CSV_COLUMNS = [
    "selected_rank", "paper_id", "title", "year", "venue", "word_count", "section_coverage", "cluster_id", "selection_score", "themes", "datasets", "metrics", "code_urls", "source_path",
    "fulltext_sha256",
]
LISTS = ("themes", "datasets", "metrics", "code_urls")
CHUNK = 40


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One named file, through Hadoop's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def copy_raw(raw: DataFrame, folder: str) -> DataFrame:
    """raw: name, content (bytes). Writes each content as it is to folder/name, on the executors; name, size, sha256 of what was written.

    A file appears under its name only when it is whole, so that a task that runs again does no harm.
    """
    folder = qualified(raw.sparkSession, folder)

    def run(batches):
        import hashlib
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target, content = f"{top}/{name}", content or b""
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as stream:
                    stream.write(content)
                fs.move(part, target)
                out.append((name, len(content), hashlib.sha256(content).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["name", "size", "sha256"])

    return raw.select("name", "content").mapInArrow(run, "name string, size long, sha256 string")


def write_direct(selected: DataFrame, direct: Column, path: str) -> None:
    """The selected records that direct holds for, as JSON lines in one file, by score, then title, then id."""
    rows = selected.filter(direct).withColumn("value", as_json(*selected.columns))
    rows.orderBy(F.desc("selection_score"), F.lower("title"), "paper_id").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_outputs(records: DataFrame, selected: DataFrame, raw: DataFrame, out: str, failed: DataFrame | None = None, quotas: tuple[Quota, ...] = (), eligible: int | None = None, direct: Column | None = None) -> dict:
    """Everything the audit leaves, in place of whatever was in out. Returns the summary.

    raw: doc_id and content (bytes) of all documents, or text where bytes are not kept. Only selected ones are copied, byte by byte, so that the
    manifest verifies if fulltext_sha256 is of the bytes. quotas, eligible: for the quality summary. direct: which records make the direct subset.
    """
    spark = selected.sparkSession
    remove(spark, out)
    csv = selected.select(*(flatten(F.col(c)).alias(c) if c in LISTS else F.col(c) for c in CSV_COLUMNS))
    csv.orderBy("selected_rank").coalesce(1).write.option("header", "true").csv(f"{out}/registry.csv")
    lines = selected.withColumn("value", as_json(*selected.columns))
    lines.orderBy("selected_rank").select("value").coalesce(1).write.text(f"{out}/evidence.jsonl")
    chunk = F.format_string("%02d", (F.floor((F.col("selected_rank") - 1) / CHUNK) + 1).cast("int"))
    lines.select(chunk.alias("chunk"), "selected_rank", "value").repartition("chunk").sortWithinPartitions("chunk", "selected_rank").drop("selected_rank").write.partitionBy("chunk").text(f"{out}/evidence_chunks")
    content = F.col("content") if "content" in raw.columns else F.encode(F.col("text"), "UTF-8")
    wanted = raw.join(selected.select(F.col("paper_id").alias("doc_id")), "doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))
    copy_raw(wanted, f"{out}/fulltext").write.mode("overwrite").parquet(f"{out}/fulltext_written")
    sums = selected.orderBy("selected_rank").select(F.concat(F.col("fulltext_sha256"), F.lit("  fulltext/"), F.col("paper_id"), F.lit(".txt")).alias("value"))
    sums.coalesce(1).write.text(f"{out}/checksums")
    bad = failed.count() if failed is not None else 0
    parsed = records.count()
    found = summary(selected, parsed, bad)
    if failed is not None:
        failed.write.json(f"{out}/parse_failures")
    if direct is not None:
        write_direct(selected, direct, f"{out}/direct.jsonl")
    checked = quality_summary(selected, parsed + bad, parsed, parsed if eligible is None else eligible, bad, quotas)
    put_text(spark, f"{out}/quality.json", json.dumps(checked, ensure_ascii=False, indent=2))
    put_text(spark, f"{out}/summary.json", json.dumps(found, ensure_ascii=False, indent=2))
    put_text(spark, f"{out}/report.md", report(found))
    return found


def registry_path(root: str, reports="reports", name="stage3_experiment_registry.tsv") -> str:
    """Where a project's registry is: below its folder of reports."""
    return f"{root.rstrip('/')}/{reports.strip('/')}/{name}"


def init_registry(spark: SparkSession, path: str, force=False) -> None:
    """An empty registry with its header. A registry that is there stays, and the call fails, unless force is set."""
    spark.createDataFrame([], REGISTRY).coalesce(1).write.mode("overwrite" if force else "errorifexists").option("header", "true").option("sep", "\t").csv(path)
