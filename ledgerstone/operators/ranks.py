"""Global ranks without a global sort in one task: distinct values are dealt into ranges, and what lies before each range is added to what lies before a value inside it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import materialise


def before(values: DataFrame, key: str, sums: tuple[str, ...]) -> DataFrame:
    """values, one row a distinct key, with before_<s> for each of sums: the sum over all lesser keys.

    Ranges are written as they were dealt, so that their offsets hold whatever is run again; there are as many of them as shuffle partitions.
    """
    dealt = materialise(values.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")
    lesser = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a shuffle partition
    offsets = dealt.groupBy("range").agg(*(F.sum(s).alias(s) for s in sums)).select("range", *(F.coalesce(F.sum(s).over(lesser), F.lit(0)).alias(f"offset_{s}") for s in sums))
    inside = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"inside_{s}") for s in sums)).join(F.broadcast(offsets), "range")
    return placed.select(*values.columns, *((F.col(f"inside_{s}") + F.col(f"offset_{s}")).alias(f"before_{s}") for s in sums))


def counted_values(rows: DataFrame, column: str) -> DataFrame:
    """v, n: each value of a column, null among them, and how many rows have it, materialised."""
    return materialise(rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")), "values")


def quantiles(values: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """One row: q0, q1, ... the exact quantiles of what counted_values() gives, between two values as far along as the share is between their ranks. Nulls don't count; without values they are null."""
    placed = before(values.filter(F.col("v").isNotNull()).select(F.col("v").cast("double").alias("v"), "n"), "v", ("n",))
    n = placed.agg(F.sum("n")).first()[0] or 0

    def at(rank):
        return F.max(F.when((F.col("before_n") <= rank) & (F.col("before_n") + F.col("n") > rank), F.col("v")))

    def between(share):
        place = share * max(0, n - 1)
        low, high = math.floor(place), math.ceil(place)
        return at(low) + (at(high) - at(low)) * (place - low) if high > low else at(low)

    return placed.agg(*(between(s).alias(f"q{i}") for i, s in enumerate(shares)))


def ranking(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: auroc and auprc, exact on any doubles. A tie of a positive and a negative is half a win; rows of one score are one step of the precision-recall curve.

    truth: 0 or 1. Rows with a null in either column don't count. Without rows of both classes auroc is null, without positives auprc is.
    """
    known = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    values = known.groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    placed = before(values, "v", ("p", "n"))
    total = values.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # Twice the negatives below a score, and those at it.
    below = 2 * (wide("before_n") - wide("before_p")) + wide("n") - wide("p")
    steps = placed.crossJoin(total)  # one row
    precision = (F.col("all_p") - F.col("before_p")) / (F.col("all_n") - F.col("before_n"))
    found = steps.agg(F.sum((wide("p") * below).cast("decimal(38,0)")).cast("double").alias("wins"), F.sum(F.col("p") * precision).alias("steps"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    pairs = 2.0 * F.col("all_p") * (F.col("all_n") - F.col("all_p"))
    return found.select(F.try_divide("wins", pairs).alias("auroc"), F.try_divide("steps", F.col("all_p").cast("double")).alias("auprc"))
