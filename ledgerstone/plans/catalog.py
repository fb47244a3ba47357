"""All queries of the audit by name, and their SQL."""

from . import ledgers, papers, policies, registry, whole

QUERIES = registry.QUERIES | papers.QUERIES | policies.QUERIES | ledgers.QUERIES | whole.QUERIES
ORACLES = registry.ORACLES | papers.ORACLES | policies.ORACLES | policies.SCANS | ledgers.ORACLES | whole.ORACLES
