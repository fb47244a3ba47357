import pytest
from helpers import DATA, same_rows

from ledgerstone.plans import catalog

# Queries that select more rows than the smallest tables have, or find none there.
LARGER = {"v2_selection_rank", "quota_report", "content_overlap", "split_leakage", "number_sentences"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, larger, name):
    con, folder = (larger, DATA.replace("0.001", "0.01")) if name in LARGER else (duck, DATA)
    n = same_rows(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name])
    assert n


def test_what_has_no_sql_is_known():
    """Labels of clusters can't be compared: its invariants are, in strata_invariants and in test_functions.py."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"semantic_strata"}
