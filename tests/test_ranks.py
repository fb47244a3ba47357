"""Exact ranks, quantiles and areas against plain computations."""

import random

import pytest

from ledgerstone.operators import leakage, ranks, summary


def areas(rows):
    rows = [(y, s) for y, s in rows if y is not None and s is not None]
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((a > b) + (a == b) / 2 for a in p for b in n)
    steps = sum(sum(1 for a in p if a == v) * sum(1 for a in p if a >= v) / sum(1 for _, s in rows if s >= v) for v in set(p))
    return (wins / (len(p) * len(n)) if p and n else None), (steps / len(p) if p else None)


@pytest.mark.parametrize("kind", ["near", "negative", "ties", "beyond", "nulls", "one class", "none", "many"])
def test_areas_are_exact(spark, kind):
    rng = random.Random(kind)
    rows = {
        "near": [(i % 2, 0.1001 + i * 1e-4) for i in range(5)][::-1],
        "negative": [(rng.randint(0, 1), rng.uniform(-5, -1)) for _ in range(60)],
        "ties": [(rng.randint(0, 1), rng.randint(0, 3) / 1.0) for _ in range(80)],
        "beyond": [(1, 7.5), (0, 3.0), (0, 1e300), (1, -1e300), (0, 0.0), (1, -0.0)],
        "nulls": [(1, None), (None, 0.3), (0, 0.1), (1, 0.2)],
        "one class": [(1, 0.5), (1, 0.6)],
        "none": [],
        "many": [(rng.randint(0, 1), rng.gauss(0, 1)) for _ in range(700)],
    }[kind]
    df = spark.createDataFrame(rows, "y int, s double").repartition(3)
    got, want = tuple(ranks.ranking(df, "y", "s").first()), areas(rows)
    assert got == tuple(None if w is None else pytest.approx(w, abs=1e-12) for w in want)
    assert leakage.auroc(df, "y", "s").first()[0] == got[0] and leakage.auprc(df, "y", "s").first()[0] == got[1]


@pytest.mark.parametrize("values", [[], [3], [1, 2], [5, 1, 4, None, 4, 4], list(range(1000)), [None, None], [7] * 50 + [9]])
def test_measures(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(3)
    got, known = summary.measures(df, "x").first(), sorted(v for v in values if v is not None)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
    assert tuple(got) == (len(values), sum(known) if known else None, min(known, default=None), max(known, default=None), sum(known) / len(known) if known else None, middle)


def test_quantiles_between_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = [*rng.standard_normal(333).tolist(), float("-inf"), 1e9, -0.5, -0.5]
    found = ranks.quantiles(ranks.counted_values(spark.createDataFrame([(v,) for v in x], "x double"), "x"), (0.1, 0.25, 0.9, 1.0)).first()
    assert [found[i] for i in range(4)] == pytest.approx([float(v) for v in np.quantile(x, [0.1, 0.25, 0.9, 1.0])])


def test_quotas_by_rounds_pick_what_the_driver_picks(spark):
    from ledgerstone.config import Quota
    from ledgerstone.operators import select

    rng = random.Random(8)
    rows = [(i, rng.choice(["T", "t", "u"]), 0, float(rng.choice([1, 1, 1, 2, 3])), rng.sample("abcd", rng.randint(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, title string, stratum int, score double, themes array<string>").repartition(5)
    for quotas in ((Quota("b", 30), Quota("a", 55), Quota("c", 1), Quota("d", 1000)), (), (Quota("none", 5), Quota("a", 0), Quota("b", 7))):
        here, there = (sorted((r["phase"], r["step"], r["doc_id"]) for r in select.sequential_quotas(df, quotas, driver_rows=n).collect()) for n in (10_000, -1))
        assert here == there and (here or not quotas)
