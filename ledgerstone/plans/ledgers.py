"""Queries of the ledgers: registries of runs, claims, reviews, gates, objectives and routes, laid out from the given tables the same way in both engines. And their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..schemas import CLAIM_COLUMNS, NOT_PROMOTABLE
from .registry import CLAIM_STATUSES, CLAIM_TYPES, SEVERITIES, quoted, table

STATES = {"metric": ("passed", "failed", "not applicable"), "guardrail": ("passed", "failed", "pending"), "leakage": ("clean", "failed", "pending")}
STOPS = ("user_paused", "budget_spent")
ITEMS = ("goal", "metric", "baseline", "guardrail")
CORRECTED = ("r58", "r87", "r31")


def text(number: str) -> str:
    return f"CAST({number} AS {{text}})"


def choice(by: str, values, rest: str = "NULL") -> str:
    return f"CASE {by} {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} ELSE {rest} END"


def words(values) -> list[str]:
    return [f"'{v}'" for v in values]


# Each ledger: the table it is laid out from, and its columns. {text} is the engine's name of the type of texts.
VALUE = f"CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN NULL ELSE {text('CAST(floor(o_totalprice) AS BIGINT)')} END"
RUNS = {
    "run_order": text("o_orderkey"), "campaign": f"concat('c', {text('o_custkey')})", "run_id": f"concat('r', {text('CASE WHEN o_orderkey % 89 = 0 THEN o_custkey ELSE o_orderkey END')})",
    "parent_run_id": f"CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE 'root' END WHEN o_orderkey % 13 = 0 THEN 'zz' ELSE concat('r', {text('o_orderkey - 1')}) END",
    "role": "CASE WHEN o_orderkey % 5 = 0 THEN 'baseline' WHEN o_orderkey % 103 = 0 THEN 'observer' ELSE 'candidate' END", "change_axis": "''", "change_summary": "o_orderpriority", "scope_version": f"concat('v', {text('o_orderkey % 2')})",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'timed_out' ELSE 'completed' END", "decision": choice("o_orderkey % 6", words(("keep", "discard", "blocked", "exploratory", "keep")), "'maybe'"), "primary_metric": "'score'", "primary_value": VALUE,
    "guardrail_summary": "CASE WHEN o_orderkey % 11 = 0 THEN 'Failed: leak' ELSE 'ok' END", "artifacts": "'a; b'", "report_ref": "''", "notes": "''",
}
CUSTOMER = f"concat('c', {text('c_custkey')})"
LAYOUTS = {
    "runs": ("orders", RUNS),
    "rewritten": ("(SELECT * FROM orders WHERE o_orderkey % 29 <> 0)", RUNS | {"primary_value": f"CASE WHEN o_orderkey % 31 = 0 THEN '0.5' ELSE {VALUE} END"}),
    "scores": ("orders", {"run_id": f"concat('r', {text('o_orderkey')})", "score": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) END"}),
    "flags": ("orders", {"campaign": RUNS["campaign"], "run_id": RUNS["run_id"], "label_informed_pruning": choice("o_orderkey % 3", ("true", "false")), "test_set_selection": choice("o_custkey % 4", ("true", "false", "false"))}),
    "claims": ("part", {
        "claim_id": f"concat('k', {text('p_partkey')})", "claim_text": "p_name", "claim_type": choice("p_size % 9", words(CLAIM_TYPES), "'guess'"), "evidence_artifact_or_citation": choice("p_partkey % 4", ("NULL", "' '"), "'t.json'"), "metric_or_check": "''", "protocol_scope": "''",
        "status": choice("p_partkey % 7", words(CLAIM_STATUSES), "'rumoured'"), "limitations": "''", "next_action": "''",
    }),
    "reported": ("(SELECT * FROM part WHERE p_partkey % 3 = 0)", {"claim_id": f"concat('k', {text('p_partkey')})", "deliverable": "p_brand"}),
    "reviews": ("events", {"comment_id": f"concat('m', {text('event_id')})", "run_id": f"concat('r', {text('user_id')})", "severity": choice("event_id % 6", words(SEVERITIES), "'praise'"), "text": "event_type", "resolved": choice("event_id % 4", ("true", "NULL"), "false"), "score": "value"}),
    "gates": ("customer", {
        "campaign": f"concat('c', {text('c_custkey % 500')})", "gate": choice("c_custkey % 4", words(STATES), "'claims'"), "state": "CASE WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'clean' ELSE 'passed' END", "applicable": choice("c_custkey % 9", ("false", "NULL"), "true"),
    }),
    "objectives": ("customer", {"campaign": CUSTOMER, "target_met": choice("c_custkey % 3", ("true", "false")), "validated": choice("c_custkey % 4", ("true", "true", "false")), "stop_reason": choice("c_custkey % 5", words(("user_paused", "tired", "budget_spent")))}),
    "aims": ("customer", {"campaign": CUSTOMER, "goal": "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END", "metric": "c_mktsegment", "baseline": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END", "guardrail": "CASE WHEN c_acctbal < 0 THEN '' ELSE 'none' END"}),
    "routes": ("lineitem", {"topic": f"concat('o', {text('l_orderkey')})", "idea": "CASE WHEN l_linenumber = 3 AND l_orderkey % 4 = 0 THEN '' ELSE l_returnflag END", "risk": "CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_linestatus END"}),
    "sections": ("pages", {"section": choice("page_id % 3", words(("methods", "results")), "'intro'"), "risk_tolerance": choice("page_id % 2", ("'bold'",))}),
}


def laid(spark, d, name):
    """A ledger of the given tables' rows."""
    source, columns = LAYOUTS[name]
    inner, _, where = source.removeprefix("(SELECT * FROM ").removesuffix(")").partition(" WHERE ")
    rows = table(spark, d, inner)
    return (rows.filter(where) if where else rows).selectExpr(*(f"{e.format(text='STRING')} AS {c}" for c, e in columns.items()))


def laid_sql(name):
    source, columns = LAYOUTS[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items()).format(text='VARCHAR')} FROM {source})"


def registry_checks(spark, d):
    return ledger.check_registry(laid(spark, d, "runs"))


def best_runs(spark, d):
    return ledger.best_kept(laid(spark, d, "runs"))


def decision_tally(spark, d):
    return ledger.decisions(laid(spark, d, "runs"))


def registry_rewrites(spark, d):
    lost = ledger.rewritten(laid(spark, d, "runs"), laid(spark, d, "rewritten"), CORRECTED)
    return lost.select("campaign", "run_id", "run_order", "primary_value")


def reviews_as_reasons(spark, d):
    return ledger.kept_by_review(laid(spark, d, "runs"), laid(spark, d, "scores"))


def selection_flags(spark, d):
    return ledger.selection_flags(laid(spark, d, "flags"))


def claim_checks(spark, d):
    return ledger.check_claims(laid(spark, d, "claims"), laid(spark, d, "reported"), CLAIM_TYPES, CLAIM_STATUSES)


def review_triage(spark, d):
    return ledger.triage(laid(spark, d, "reviews"), SEVERITIES)


def gate_report(spark, d):
    return ledger.accepted(laid(spark, d, "gates"))


def gate_states(spark, d):
    return ledger.bad_states(laid(spark, d, "gates"), STATES).select("campaign", "gate", "state")


def completion(spark, d):
    return ledger.completion(laid(spark, d, "objectives"), STOPS)


def missing_items(spark, d):
    found = ledger.missing_items(laid(spark, d, "aims"), ITEMS)
    return found.select("campaign", F.array_join("missing", ",").alias("missing"))


def route_checks(spark, d):
    return ledger.check_routes(laid(spark, d, "routes"), ("idea", "risk"))


def writing_controls(spark, d):
    return ledger.writing_controls(laid(spark, d, "sections"))


QUERIES = {
    f.__name__: f
    for f in (registry_checks, best_runs, decision_tally, registry_rewrites, reviews_as_reasons, selection_flags, claim_checks, review_triage, gate_report, gate_states, completion, missing_items, route_checks, writing_controls)
}

GAINS = f"""r AS (SELECT *, try_cast(run_order AS BIGINT) AS o, try_cast(primary_value AS DOUBLE) AS v FROM {laid_sql('runs')}),
g AS (SELECT *, v - first(CASE WHEN role = 'baseline' THEN v END ORDER BY CASE WHEN role = 'baseline' AND v IS NOT NULL THEN 0 ELSE 1 END, o, run_id) OVER (PARTITION BY campaign, scope_version) AS gain FROM r)"""
OPEN = "NOT coalesce(state = 'passed' OR NOT coalesce(applicable, true), false)"
PLACE = f"coalesce(list_position([{quoted(SEVERITIES)}], severity), 6)"
MISSING = ", ".join(f"CASE WHEN trim(coalesce({i}, '')) = '' THEN '{i}' END" for i in ITEMS)
ORACLES = {
    "registry_checks": f"""WITH {GAINS},
e AS (SELECT *, CASE WHEN status <> 'completed' THEN 'blocked' WHEN contains(lower(guardrail_summary), 'fail') OR coalesce(gain <= 0, true) THEN 'discard' ELSE 'keep' END AS expected FROM g WHERE role = 'candidate')
SELECT campaign, run_id, 'unknown_role' AS rule, role AS detail FROM r WHERE role NOT IN ('baseline', 'candidate')
UNION ALL SELECT campaign, run_id, 'unknown_decision', decision FROM r WHERE decision NOT IN ('keep', 'discard', 'blocked', 'exploratory')
UNION ALL SELECT campaign, run_id, 'value_not_a_number', coalesce(primary_value, '') FROM r WHERE v IS NULL AND status = 'completed'
UNION ALL SELECT campaign, run_id, 'duplicate_run', count(*)::VARCHAR FROM r GROUP BY campaign, run_id HAVING count(*) > 1
UNION ALL SELECT campaign, run_id, 'orphan_parent', parent_run_id FROM r WHERE role <> 'baseline' AND parent_run_id NOT IN (SELECT run_id FROM r)
UNION ALL SELECT campaign, run_id, 'baseline_parent', parent_run_id FROM r WHERE role = 'baseline' AND parent_run_id <> 'root'
UNION ALL (SELECT campaign, run_id, 'baseline_not_first', role FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY o, run_id) AS i FROM r) WHERE i = 1 AND role <> 'baseline')
UNION ALL SELECT campaign, min(run_id), 'scope_without_baseline', scope_version FROM r GROUP BY campaign, scope_version HAVING count(*) FILTER (role = 'baseline') = 0
UNION ALL SELECT campaign, run_id, 'unjustified_decision', decision || '>' || expected FROM e WHERE decision = 'keep' AND expected <> 'keep' OR expected = 'blocked' AND decision <> 'blocked'""",
    "best_runs": f"WITH {GAINS} SELECT campaign, run_id, v AS primary_value FROM r WHERE decision = 'keep' AND status = 'completed' AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY v DESC, run_id DESC) = 1",
    "decision_tally": f"SELECT campaign, {', '.join(f'count(*) FILTER (decision = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in ('keep', 'discard', 'blocked', 'exploratory'))} FROM {laid_sql('runs')} GROUP BY campaign",
    "registry_rewrites": f"SELECT campaign, run_id, run_order, primary_value FROM (SELECT * FROM {laid_sql('runs')} EXCEPT ALL SELECT * FROM {laid_sql('rewritten')}) WHERE run_id NOT IN ({quoted(CORRECTED)})",
    "reviews_as_reasons": f"""WITH {GAINS}, s AS (SELECT run_id, max(score) AS score FROM {laid_sql('scores')} WHERE score IS NOT NULL GROUP BY run_id)
SELECT campaign, g.run_id, 'kept_by_review_score' AS rule, s.score::VARCHAR AS detail FROM g JOIN s USING (run_id) LEFT JOIN s p ON p.run_id = g.parent_run_id WHERE decision = 'keep' AND role = 'candidate' AND s.score > coalesce(p.score, '-inf'::DOUBLE) AND coalesce(gain <= 0, true)""",
    "selection_flags": f"""WITH f AS (SELECT * FROM {laid_sql('flags')})
SELECT campaign, run_id, rule, CASE WHEN x IS NULL THEN 'not recorded' ELSE 'set' END AS detail FROM (SELECT campaign, run_id, 'label_informed_pruning' AS rule, label_informed_pruning AS x FROM f UNION ALL SELECT campaign, run_id, 'test_set_selection', test_set_selection FROM f) WHERE coalesce(x, true)""",
    "claim_checks": f"""WITH c AS (SELECT * FROM {laid_sql('claims')})
SELECT claim_id, 'unknown_claim_type' AS rule FROM c WHERE claim_type NOT IN ({quoted(CLAIM_TYPES)})
UNION ALL SELECT claim_id, 'unknown_status' FROM c WHERE status NOT IN ({quoted(CLAIM_STATUSES)})
UNION ALL SELECT claim_id, 'no_evidence' FROM c WHERE status = 'supported' AND trim(coalesce(evidence_artifact_or_citation, '')) = ''
UNION ALL SELECT claim_id, 'reported_too_early' FROM c WHERE status IN ({quoted(NOT_PROMOTABLE)}) AND claim_id IN (SELECT claim_id FROM {laid_sql('reported')})""",
    "review_triage": f"SELECT run_id, comment_id, severity, {PLACE}::INT AS ordinal, {PLACE} <= 3 AS blocks FROM {laid_sql('reviews')} WHERE NOT coalesce(resolved, false)",
    "gate_report": f"SELECT campaign, bool_and(NOT ({OPEN})) AS accepted, count(*) FILTER ({OPEN}) AS open_gates FROM {laid_sql('gates')} GROUP BY campaign",
    "gate_states": f"SELECT campaign, gate, state FROM {laid_sql('gates')} WHERE NOT coalesce(CASE gate {' '.join(f'WHEN {chr(39)}{g}{chr(39)} THEN state IN ({quoted(v)})' for g, v in STATES.items())} END, false)",
    "completion": f"SELECT campaign, CASE WHEN coalesce(target_met, false) AND coalesce(validated, false) THEN 'complete' WHEN stop_reason IN ({quoted(STOPS)}) THEN stop_reason ELSE 'target not met' END AS outcome FROM {laid_sql('objectives')}",
    "missing_items": f"SELECT * FROM (SELECT campaign, concat_ws(',', {MISSING}) AS missing FROM {laid_sql('aims')}) WHERE missing <> ''",
    "route_checks": f"""WITH r AS (SELECT topic, count(*) AS n, count(*) FILTER (trim(coalesce(idea, '')) = '' OR trim(coalesce(risk, '')) = '') AS gaps FROM {laid_sql('routes')} GROUP BY topic)
SELECT topic, 'number_of_routes' AS rule FROM r WHERE n NOT BETWEEN 3 AND 5 UNION ALL SELECT topic, 'empty_field' FROM r WHERE gaps > 0""",
    "writing_controls": f"SELECT section, CASE WHEN section IN ('methods', 'results') THEN 'conservative' ELSE coalesce(risk_tolerance, 'balanced') END AS risk_tolerance FROM {laid_sql('sections')}",
}
