"""Checks of experiment registries, claim ledgers, reviews, gates and objectives. Each check is a query that returns what breaks a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DECISIONS, NOT_PROMOTABLE, REGISTRY_COLUMNS, ROLES, STATUSES


def schema_matches(registry: DataFrame) -> bool:
    return registry.columns == REGISTRY_COLUMNS


def typed(registry: DataFrame) -> DataFrame:
    """The registry with run_order and primary_value as numbers (null if they aren't) and artifacts as a list."""
    return registry.withColumns({"run_order": F.col("run_order").try_cast("long"), "primary_value": F.col("primary_value").try_cast("double"), "artifacts": F.filter(F.transform(F.split("artifacts", ";"), F.trim), lambda x: x != "")})


def broken(rows: DataFrame, rule: str, detail) -> DataFrame:
    return rows.select("campaign", "run_id", F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def bad_values(registry: DataFrame, open_status=True) -> list[DataFrame]:
    out = [broken(registry.filter(~F.coalesce(F.col(c).isin(*v), F.lit(False))), f"unknown_{c}", F.col(c)) for c, v in (("role", ROLES), ("decision", DECISIONS))]
    if not open_status:
        out.append(broken(registry.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "unknown_status", F.col("status")))
    return [*out, broken(registry.filter(F.col("primary_value").try_cast("double").isNull() & (F.col("status") == "completed")), "value_not_a_number", F.col("primary_value"))]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, before they are sorted or counted: what a task sorts is a share of a shuffle, and not a whole split of a file, which may be twenty times as large in memory as on disk."""
    return rows.repartition(*keys)


def duplicate_runs(registry: DataFrame) -> DataFrame:
    twice = dealt(registry, "campaign").groupBy("campaign", "run_id").agg(F.count("*").alias("n")).filter("n > 1")
    return broken(twice, "duplicate_run", F.col("n"))


def orphans(registry: DataFrame) -> DataFrame:
    """Candidates whose parent isn't a run, and baselines whose parent isn't the root."""
    runs = dealt(registry.select(F.col("run_id").alias("parent_run_id")), "parent_run_id").distinct()
    lost = registry.filter(F.col("role") != "baseline").join(runs, "parent_run_id", "left_anti")
    rootless = registry.filter((F.col("role") == "baseline") & (F.coalesce("parent_run_id", F.lit("")) != "root"))
    return broken(lost, "orphan_parent", F.col("parent_run_id")).unionByName(broken(rootless, "baseline_parent", F.col("parent_run_id")))


def late_baselines(registry: DataFrame) -> DataFrame:
    """Campaigns whose first run isn't a baseline."""
    first = F.row_number().over(Window.partitionBy("campaign").orderBy(F.col("run_order").try_cast("long"), "run_id"))
    return broken(dealt(registry, "campaign").withColumn("i", first).filter((F.col("i") == 1) & ~F.col("role").eqNullSafe("baseline")), "baseline_not_first", F.col("role"))


def scopes_without_baseline(registry: DataFrame) -> DataFrame:
    scope = ["campaign", "scope_version"]
    grouped = dealt(registry, "campaign").groupBy(*scope).agg(F.min("run_id").alias("run_id"), F.count_if(F.col("role") == "baseline").alias("n")).filter("n = 0")
    return broken(grouped, "scope_without_baseline", F.col("scope_version"))


def gains(registry: DataFrame, higher_is_better=True) -> DataFrame:
    """Each run's gain over the baseline of its campaign and scope."""
    base = F.first(F.when(F.col("role") == "baseline", F.col("primary_value")), ignorenulls=True).over(Window.partitionBy("campaign", "scope_version").orderBy("run_order", "run_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gain = F.col("primary_value") - base
    return typed(registry).withColumn("gain", gain if higher_is_better else -gain)


def expected_decisions(registry: DataFrame, higher_is_better=True) -> DataFrame:
    """What each candidate's decision may be: blocked unless completed; no keep without a gain or with a failed guardrail."""
    failed = F.contains(F.lower(F.coalesce("guardrail_summary", F.lit(""))), F.lit("fail"))
    expected = F.when(F.col("status") != "completed", "blocked").when(failed | F.coalesce(F.col("gain") <= 0, F.lit(True)), "discard").otherwise("keep")
    return gains(registry, higher_is_better).filter(F.col("role") == "candidate").withColumn("expected", expected)


def unjustified(registry: DataFrame, higher_is_better=True) -> DataFrame:
    rows = expected_decisions(registry, higher_is_better)
    wrong = ((F.col("decision") == "keep") & (F.col("expected") != "keep")) | ((F.col("expected") == "blocked") & (F.col("decision") != "blocked"))
    return broken(rows.filter(wrong), "unjustified_decision", F.concat_ws(">", "decision", "expected"))


def kept_by_review(registry: DataFrame, reviews: DataFrame, higher_is_better=True) -> DataFrame:
    """Kept candidates whose review score rose over their parent's while the primary metric did not: campaign, run_id, rule, detail. reviews: run_id, score."""
    score = reviews.filter("score is not null").groupBy("run_id").agg(F.max("score").alias("score"))
    kept = gains(registry, higher_is_better).filter((F.col("decision") == "keep") & (F.col("role") == "candidate")).join(score, "run_id")
    parent = score.select(F.col("run_id").alias("parent_run_id"), F.col("score").alias("before"))
    rose = kept.join(parent, "parent_run_id", "left").filter((F.col("score") > F.coalesce("before", F.lit(float("-inf")))) & F.coalesce(F.col("gain") <= 0, F.lit(True)))
    return broken(rose, "kept_by_review_score", F.col("score"))


def selection_flags(audits: DataFrame, flags=("label_informed_pruning", "test_set_selection")) -> DataFrame:
    """campaign, run_id, rule, detail: recorded flags that are set, or that nobody recorded."""
    found = F.filter(F.array(*(F.struct(F.lit(f).alias("flag"), F.when(F.col(f).isNull(), "not recorded").when(F.col(f), "set").alias("state")) for f in flags)), lambda x: x["state"].isNotNull())
    return audits.select("campaign", "run_id", F.explode(found).alias("x")).select("campaign", "run_id", F.col("x.flag").alias("rule"), F.col("x.state").alias("detail"))


def check_registry(registry: DataFrame, higher_is_better=True) -> DataFrame:
    """campaign, run_id, rule, detail of everything that breaks a rule."""
    found = [*bad_values(registry), duplicate_runs(registry), orphans(registry), late_baselines(registry), scopes_without_baseline(registry), unjustified(registry, higher_is_better)]
    return reduce(DataFrame.unionByName, found)


def rewritten(old: DataFrame, new: DataFrame, corrected=()) -> DataFrame:
    """Rows of old that new lost or changed, but for run ids flagged as corrected."""
    lost = old.exceptAll(new.select(*old.columns))
    return lost.filter(~F.col("run_id").isin(*corrected)) if corrected else lost


def best_kept(registry: DataFrame, higher_is_better=True) -> DataFrame:
    """campaign, run_id, primary_value of the best kept and completed run."""
    key = F.col("primary_value") if higher_is_better else -F.col("primary_value")
    kept = typed(registry).filter((F.col("decision") == "keep") & (F.col("status") == "completed") & F.col("primary_value").isNotNull())
    return kept.groupBy("campaign").agg(F.max_by("run_id", F.struct(key, "run_id")).alias("run_id"), F.max_by("primary_value", F.struct(key, "run_id")).alias("primary_value"))


def decisions(registry: DataFrame) -> DataFrame:
    return registry.groupBy("campaign").agg(*(F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in DECISIONS))


def check_claims(claims: DataFrame, reported: DataFrame, types, statuses) -> DataFrame:
    """claim_id, rule: unknown types and statuses, supported claims without evidence, reported claims that mustn't be."""
    unknown = [claims.filter(~F.coalesce(F.col(c).isin(*v), F.lit(False))).select("claim_id", F.lit(f"unknown_{c}").alias("rule")) for c, v in (("claim_type", types), ("status", statuses))]
    bare = claims.filter((F.col("status") == "supported") & (F.trim(F.coalesce("evidence_artifact_or_citation", F.lit(""))) == "")).select("claim_id", F.lit("no_evidence").alias("rule"))
    early = claims.filter(F.col("status").isin(*NOT_PROMOTABLE)).join(reported.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", F.lit("reported_too_early").alias("rule"))
    return reduce(DataFrame.unionByName, [*unknown, bare, early])


def triage(reviews: DataFrame, severities, blocking=3) -> DataFrame:
    """Open comments in the order they are acted on; blocks: the severity is one of the first. severities: in that order."""
    ordinal = F.array_position(F.array(*map(F.lit, severities)), F.col("severity")).cast("int")
    rows = reviews.withColumn("ordinal", F.when(ordinal == 0, len(severities) + 1).otherwise(ordinal)).filter(~F.coalesce("resolved", F.lit(False)))
    return rows.select("run_id", "comment_id", "severity", "ordinal", (F.col("ordinal") <= blocking).alias("blocks"))


def accepted(gates: DataFrame, passed="passed") -> DataFrame:
    """campaign, accepted: every gate that applies has passed."""
    ok = (F.col("state") == passed) | ~F.coalesce("applicable", F.lit(True))
    return gates.groupBy("campaign").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("accepted"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("open_gates"))


def bad_states(gates: DataFrame, states: dict[str, tuple[str, ...]]) -> DataFrame:
    """Gates in a state that their vocabulary hasn't."""
    known = F.coalesce(*(F.when(F.col("gate") == g, F.col("state").isin(*v)) for g, v in states.items()), F.lit(False))
    return gates.filter(~F.coalesce(known, F.lit(False)))


def completion(objectives: DataFrame, stop_reasons) -> DataFrame:
    """campaign, outcome: complete, stopped for a known reason, or target not met. objectives: target_met, validated, stop_reason."""
    done = F.coalesce("target_met", F.lit(False)) & F.coalesce("validated", F.lit(False))
    return objectives.select("campaign", F.when(done, "complete").when(F.col("stop_reason").isin(*stop_reasons), F.col("stop_reason")).otherwise("target not met").alias("outcome"))


def missing_items(objectives: DataFrame, items) -> DataFrame:
    """campaign, missing: the items of an objective ledger that are null or blank."""
    gaps = F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in items)), lambda x: x.isNotNull())
    return objectives.select("campaign", gaps.alias("missing")).filter(F.size("missing") > 0)


def check_routes(routes: DataFrame, fields, least=3, most=5) -> DataFrame:
    """topic, rule: too few or too many candidate routes, or routes with an empty field."""
    empty = reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in fields))
    counts = routes.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(empty).alias("gaps"))
    many = counts.filter(~F.col("n").between(least, most)).select("topic", F.lit("number_of_routes").alias("rule"))
    return many.unionByName(counts.filter("gaps > 0").select("topic", F.lit("empty_field").alias("rule")))


def writing_controls(rows: DataFrame, careful=("methods", "results"), default="balanced") -> DataFrame:
    """section, risk_tolerance: conservative in careful sections whatever is asked for."""
    return rows.select("section", F.when(F.col("section").isin(*careful), "conservative").otherwise(F.coalesce("risk_tolerance", F.lit(default))).alias("risk_tolerance"))
