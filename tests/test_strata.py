"""TF-IDF by dictionary, truncated SVD and mini-batch k-means against plain computations."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerstone.operators import strata


def brute(texts, features, max_df=0.92, stop=()):
    """(id, term): weight of the `features` commonest terms."""
    held = {}
    for i, t in texts.items():
        w = [x for x in re.findall(r"\b\w\w+\b", (t or "").lower()) if x not in stop]
        held[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df, total, n, out = Counter(t for c in held.values() for t in c), sum(held.values(), Counter()), len(texts), {}
    known = set(sorted((t for t in df if 2 <= df[t] <= max_df * n), key=lambda t: (-total[t], t))[:features])
    for i, c in held.items():
        raw = {t: (1 + math.log(tf)) * (1 + math.log((1 + n) / (1 + df[t]))) for t, tf in c.items() if t in known}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, t): v / length for t, v in raw.items()}
    return out


def texts(n=150, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "Über", "naïve", "a"]
    return {i: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) for i in range(n)} | {n: None, n + 1: ""}


@pytest.mark.parametrize(("features", "stop", "most"), [(7, (), 1 << 19), (60, ("the", "w0"), 1 << 19), (400, (), 1 << 19), (60, (), 0), (10_000, (), 1 << 19), (1, (), 1 << 19)])
def test_weights_of_the_commonest_terms(spark, features, stop, most):
    held = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in held.items()], "doc_id long, body string, term int")
    rows, terms = strata.weigh(docs, "body", features=features, stop=stop, most=most)
    got = {(r["doc_id"], terms[p]): w for r in rows.collect() for p, w in zip(r["places"], r["weights"])}
    want = brute(held, features, stop=stop)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and want


def test_no_texts_and_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert strata.tfidf(docs, "text").count() == 0 and strata.strata(docs, "text", 3, tries=2, rounds=5).count() == 0
    assert re.findall(strata.WORDS, "café x ab_1 हिन्दी") == ["café", "ab_1", "हिन्दी"]


def sparse(spark, a, parts=5):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "doc_id long, places array<int>, weights array<double>").repartition(parts)


def test_singular_values_and_vectors(spark):
    rng = np.random.default_rng(2)
    a = np.zeros((400, 700))
    for i in range(60):  # topics of falling weight over few rows and terms each
        a += 3 * 0.9**i * np.outer((rng.random(400) < 0.15) * rng.random(400), (rng.random(700) < 0.08) * rng.random(700))
    s, v = strata.truncated_svd(sparse(spark, a), 700, 12, rounds=4)
    want = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.abs(s / want - 1).max() < 0.01
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-8
    assert np.abs(np.linalg.norm(a @ v, axis=0) / s - 1).max() < 0.01
    again = strata.truncated_svd(sparse(spark, a, 2), 700, 12, rounds=4)
    assert np.abs(again[0] - s).max() < 1e-3


def test_reduced_rows_are_of_length_one_and_never_more_than_rows_allow(spark):
    a = np.array([[1.0, 0, 0, 2], [0, 1.0, 0, 1], [0, 1.0, 3, 0]])
    found = strata.reduced(sparse(spark, a), 4, 160).collect()
    assert {len(r["features"]) for r in found} == {2} and all(abs(np.linalg.norm(r["features"]) - 1) < 1e-6 for r in found)


def test_costs_are_near_the_best_of_full_k_means(spark):
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((12, 8)) * 2
    x = np.concatenate([m + rng.standard_normal((int(rng.integers(20, 400)), 8)) for m in middles]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, features array<float>").repartition(4).cache()
    got = strata.cluster(df, 12, tries=10, rounds=50, batch=128).collect()
    vectors = df.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    best = min(KMeans(k=12, seed=i, maxIter=100).fit(vectors).summary.trainingCost for i in range(10))
    assert sum(r["distance"] ** 2 for r in got) <= 1.05 * best
    assert {r["doc_id"] for r in got} == set(range(len(x))) and {r["cluster_id"] for r in got} == set(range(12))


def test_no_more_clusters_than_distinct_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "doc_id long, features array<float>")
    found = strata.cluster(df, 10, tries=2, rounds=10, batch=8).collect()
    assert len({r["cluster_id"] for r in found}) == 3 and max(r["distance"] for r in found) < 1e-6
