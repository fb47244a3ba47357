"""Faults of earlier rounds: norms that differ, batches that Arrow cuts, repeats that differ, archives that break."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA

from ledgerstone.llm import ann, ngram_join, warc


def tables_of_norms():
    rng = np.random.default_rng(11)
    unit = rng.standard_normal((3000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    yield "one and ten", unit * np.where(np.arange(3000) % 2, 10, 1)[:, None]
    yield "log-normal", unit * np.exp(rng.standard_normal(3000))[:, None]
    middles = rng.standard_normal((10, 32)) * 3
    yield "clusters", middles[np.arange(3000) % 10] + rng.standard_normal((3000, 32)) * rng.uniform(0.1, 2, 3000)[:, None]


@pytest.mark.parametrize(("name", "x"), list(tables_of_norms()), ids=lambda v: v if isinstance(v, str) else "")
def test_recall_whatever_the_norms(spark, name, x):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(rows, lambda i: i % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    norms, recall = np.linalg.norm(x, axis=1), {}
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        recall[q] = len(found[q] & set(np.argsort(-s)[:20].tolist())) / 20
    small = [v for q, v in recall.items() if norms[q] <= np.median(norms)]
    large = [v for q, v in recall.items() if norms[q] > np.median(norms)]
    assert len(recall) == 150 and min(np.mean(small), np.mean(large) if large else 1) >= 0.9, (np.mean(small), np.mean(large) if large else 1)


def test_batches_over_arrows_limit_are_an_error(monkeypatch):
    batch = pa.record_batch({"k": pa.array([1, 1, 2]), "v": pa.array([b"x" * 10] * 3)})
    whole = pa.Table.combine_chunks
    cut = lambda t: pa.Table.from_batches([b.slice(i, 1) for b in whole(t).to_batches() for i in range(len(b))])

    class Cut:
        from_batches = staticmethod(lambda held: type("T", (), {"combine_chunks": lambda self: cut(pa.Table.from_batches(held))})())

    held = type("P", (), {**{k: getattr(pa, k) for k in ("RecordBatch",)}, "Table": Cut})
    assert sum(map(len, ngram_join.grouped(iter([batch, batch]), 1))) == 6 and len(ann.whole(iter([batch, batch]))[0]) == 6
    monkeypatch.setattr(ngram_join, "pa", held)
    for run in (lambda: ngram_join.one_batch([batch]), lambda: list(ngram_join.grouped(iter([batch, batch]), 1)), lambda: ann.whole(iter([batch])), lambda: list(ann.chunks(iter([batch]), 1))):
        with pytest.raises(ValueError, match="2 GiB"):
            run()


def test_one_of_repeats_that_differ_stays_and_reruns_agree(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, f"s{i % 7}", i % 3) for i in range(300)] + [(i, f"text {i} with words of its own {i * i} and {i * 7}", "s", 0) for i in range(2, 600)] + [(5000, text + " more", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(1, 600))
    again = ngram_join.keep_one(docs.repartition(7)).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, again))


def test_a_broken_archive_fails_the_query(spark, monkeypatch):
    write, real = warc.write_archives, warc.materialise

    def cut(rows, folder):
        written = real(write(rows, folder), "test-warc")
        path = written.first()["path"].removeprefix("file://").removeprefix("file:")
        data = gzip.compress(gzip.decompress(open(path, "rb").read())[:-40])
        with open(path, "wb") as out:
            out.write(data)
        return written

    monkeypatch.setattr(warc, "write_archives", cut)
    with pytest.raises(ValueError):
        warc.op1_warc(spark, DATA)
