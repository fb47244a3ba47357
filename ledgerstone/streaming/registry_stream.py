"""Registry files as a stream: row rules hold for each new row at once, table rules for each batch against all that came before. Beyond what the audit needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..schemas import DECISIONS, REGISTRY, ROLES


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REGISTRY).option("sep", "\t").option("header", "true").csv(folder)


def row_rules(rows: DataFrame) -> DataFrame:
    """campaign, run_id, rule of rows that break a rule by themselves; works on streams."""
    rules = F.array(
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.lit("unknown_role")),
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), F.lit("unknown_decision")),
        F.when((F.col("status") == "completed") & F.col("primary_value").try_cast("double").isNull(), F.lit("value_not_a_number")),
    )
    return rows.select("campaign", "run_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def watch(rows: DataFrame, table: str, found: str, checkpoint: str):
    """Starts a query that appends each batch to table and writes what then breaks a rule to found. Once over all files there are."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("append").parquet(table)
        ledger.check_registry(spark.read.parquet(table)).write.mode("overwrite").parquet(f"{found}/batch={number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
