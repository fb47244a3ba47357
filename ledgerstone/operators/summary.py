"""Aggregates of an audit: counts, frequencies, histograms, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import counted_values, quantiles


def measures(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, total, least, most, mean and exact median of a numeric column, of which rows with one value are one row first."""
    values = counted_values(rows, column)
    v, n = F.col("v"), F.col("n")
    known = F.sum(F.when(v.isNotNull(), n))
    found = values.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sum(v * n).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), (F.sum(v * n) / known).alias("mean"))
    return found.crossJoin(quantiles(values, (0.5,)).select(F.col("q0").alias("median")))  # one row each


def non_empty(rows: DataFrame, columns) -> DataFrame:
    """One row: for each array column how many rows have any item."""
    return rows.agg(*(F.count_if(F.size(c) > 0).alias(f"with_{c}") for c in columns))


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """item, n of an array column's items."""
    return rows.select(F.explode(column).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest items, ties by name."""
    return frequency(rows, column).orderBy(F.desc("n"), "item").limit(k)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


LABEL = "extracted by a machine; claims that matter need a second pass by a person"


def quality_summary(selected: DataFrame, sources: int, parsed: int, eligible: int, failed: int, quotas=()) -> dict:
    """What the quality file says: counts along the way, the selection's least and median length, quotas wanted and met, rows by stratum."""
    size = measures(selected, "word_count").first()
    met = selected.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("themes", q.theme)).alias(f"q{i}") for i, q in enumerate(quotas))).first()
    return {
        "sources": sources,
        "parsed": parsed,
        "eligible": eligible,
        "selected": size["n"],
        "word_count_least": size["least"],
        "word_count_median": size["median"],
        "quotas": {q.theme: q.quota for q in quotas},
        "quotas_met": {q.theme: met[f"q{i}"] for i, q in enumerate(quotas)},
        "strata": {str(r["cluster_id"]): r["n"] for r in histogram(selected, "cluster_id").collect()},
        "failed": failed,
        "integrity": LABEL,
    }


def summary(selected: DataFrame, parsed: int, failed: int) -> dict:
    """What the summary file says. Labels say that a machine made it and nobody read the texts."""
    size = measures(selected, "word_count").first().asDict()
    some = non_empty(selected, ("method_claims", "experiment_protocol", "main_results", "ablation_evidence", "limitation_evidence")).first().asDict()
    return {
        "parsed": parsed,
        "failed": failed,
        "selected": size["n"],
        "machine_assisted": True,
        "human_reading_claimed": False,
        "word_count": {k: size[k] for k in ("total", "least", "most", "mean", "median")},
        **some,
        "themes": {r["item"]: r["n"] for r in most_common(selected, "themes", 1000).collect()},
        "datasets": {r["item"]: r["n"] for r in most_common(selected, "datasets", 50).collect()},
        "strata": {str(r["cluster_id"]): r["n"] for r in histogram(selected, "cluster_id").collect()},
    }


def report(found: dict) -> str:
    """The summary as Markdown."""
    lines = ["# Corpus audit", "", f"{found['selected']} of {found['parsed']} parsed documents are selected; {found['failed']} could not be parsed.", "", "## Themes", ""]
    lines += [f"- {name}: {n}" for name, n in found["themes"].items()]
    lines += ["", "## Data sets", "", *(f"- {name}: {n}" for name, n in list(found["datasets"].items())[:30])]
    return "\n".join([*lines, "", "## Integrity", "", "Extraction was done by a machine. No claim is made that a person has read the texts; a second pass by one is needed.", ""])
