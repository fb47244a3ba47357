"""Quality gate, direct relevance and selection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Weight


def gate(records: DataFrame, least_words=3000, least_coverage=0.6) -> DataFrame:
    """Records long enough, with enough sections, and with method, protocol and result evidence."""
    some = [F.size(c) > 0 for c in ("method_claims", "experiment_protocol", "main_results")]
    return records.filter((F.col("word_count") >= least_words) & (F.col("section_coverage") >= least_coverage) & some[0] & some[1] & some[2])


def theme(scores: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(0))


def has_theme(scores: Column, name: str) -> Column:
    return theme(scores, name) > 0


def directly_relevant(scores: Column, strong=(), pairs=(), above_one=()) -> Column:
    """Any strong theme, any theme above one, or any pair of themes together."""
    tests = [has_theme(scores, t) for t in strong] + [theme(scores, t) > 1 for t in above_one] + [has_theme(scores, a) & has_theme(scores, b) for a, b in pairs]
    return F.coalesce(*(F.when(t, True) for t in tests), F.lit(False))


def weighted(scores: Column, weights: tuple[Weight, ...]) -> Column:
    """Sum of weights times theme scores, each score no more than its cap."""
    return sum((F.lit(float(w.weight)) * (theme(scores, w.theme) if w.cap is None else F.least(theme(scores, w.theme), F.lit(w.cap))) for w in weights), F.lit(0.0))


def capped_sum(scores: Column, cap=8) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0), lambda a, v: (a + F.least(v, F.lit(cap))).cast("int"))


# The weights of the scores.
V1 = {"direct": 1.5, "capped": 0.35, "coverage": 6.0, "density": 0.8, "again": 0.8, "centrality": 4.0}
V1_EVIDENCE = ("method_claims", "main_results", "ablation_evidence", "experiment_protocol", "limitation_evidence")
V2 = {"coverage": 7.0, "datasets": 0.6, "code_urls": 1.5, "words": 7000.0, "most_words": 1.5}
V2_EVIDENCE = {"research_problem": 0.8, "method_claims": 1.0, "experiment_protocol": 0.8, "main_results": 1.0, "ablation_evidence": 0.8, "limitation_evidence": 0.5}


def density() -> Column:
    return sum((F.size(c) for c in V1_EVIDENCE), F.lit(0))


def reproducibility() -> Column:
    return F.least(F.size("datasets"), F.lit(4)) + 2 * F.least(F.size("code_urls"), F.lit(2))


def centrality(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def v1_record(weights) -> Column:
    """The part of the first audit's score that a record has of itself: direct themes, capped themes, coverage, evidence density and reproducibility."""
    scores = F.col("theme_scores")
    parts = {"direct": weighted(scores, weights), "capped": capped_sum(scores), "coverage": F.col("section_coverage"), "density": density(), "again": reproducibility()}
    return sum((V1[k] * v for k, v in parts.items()), F.lit(0.0))


def v1_placed(record: Column, distance: Column) -> Column:
    """The score from v1_record() and the distance: centrality comes last."""
    return F.round(record + V1["centrality"] * centrality(distance), 4)


def v1_score(weights, distance: Column) -> Column:
    """Direct themes, capped themes, coverage, evidence density, reproducibility and centrality."""
    return v1_placed(v1_record(weights), distance)


def v2_evidence() -> Column:
    return (
        V2["coverage"] * F.col("section_coverage")
        + sum((w * F.size(c) for c, w in V2_EVIDENCE.items()), F.lit(0.0))
        + V2["datasets"] * F.least(F.size("datasets"), F.lit(5))
        + V2["code_urls"] * F.least(F.size("code_urls"), F.lit(2))
        + F.least(F.col("word_count") / V2["words"], F.lit(V2["most_words"]))
    )


def v2_score(weights) -> Column:
    return F.round(weighted(F.col("theme_scores"), weights) + v2_evidence(), 4)
