"""Explicit schemas, and the fixed vocabularies of the ledgers."""

from __future__ import annotations

# The registry's columns in their order, and the closed vocabularies.
REGISTRY_COLUMNS = "run_order campaign run_id parent_run_id role change_axis change_summary scope_version status decision primary_metric primary_value guardrail_summary artifacts report_ref notes".split()
ROLES = ("baseline", "candidate")
STATUSES = ("completed", "failed", "invalid", "timed_out")
DECISIONS = ("keep", "discard", "blocked", "exploratory")
CLAIM_COLUMNS = "claim_id claim_text claim_type evidence_artifact_or_citation metric_or_check protocol_scope status limitations next_action".split()
NOT_PROMOTABLE = ("unsupported", "pending_validation", "superseded", "invalidated")

REGISTRY = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)
CLAIMS = ", ".join(f"{c} string" for c in CLAIM_COLUMNS)
REVIEWS = "comment_id string, run_id string, severity string, text string, resolved boolean, score double"
GATES = "campaign string, gate string, state string, applicable boolean"
