"""What findings of round 3 were about."""

import numpy as np
from helpers import DATA, runs, same_rows

from ledgerstone.llm import rules
from ledgerstone.operators import leakage, ledger, strata
from ledgerstone.plans import audit, catalog, papers
from ledgerstone.sources import corpus, work


def test_means_on_the_edge_of_rounding_match_sql(spark, larger):
    assert same_rows(catalog.QUERIES["generalisation"](spark, DATA.replace("0.001", "0.01")), larger, catalog.ORACLES["generalisation"])


def test_means_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [("a", i, 1.0 / (i + 1)) for i in range(2000)] + [("a", 7, None), ("b", 1, None), (None, 3, 0.5)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    found = [{r["k"]: r["mean"] for r in leakage.means_in_order(df.repartition(n, *by), ("k",), "v", "i", 500).collect()} for n, by in ((1, ()), (7, ()), (4, ("v",)))]
    assert found[0] == {"a": found[0]["a"], "b": None, None: 0.5}
    assert abs(found[0]["a"] - sum(r[2] for r in rows[:2000]) / 2000) < 1e-15
    total = 0.0
    for r in rows[:2000]:
        total += r[2]  # sum() would add exactly
    whole = [leakage.means_in_order(df.repartition(n), ("k",), "v", "i").filter("k = 'a'").first()["mean"] for n in (1, 7)]
    assert whole == [total / 2000] * 2


def test_scored_records_join_nothing(spark):
    scored = papers.scored(spark, DATA)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.filter("cluster_id is not null").count() == papers.papers(spark, DATA).count()


def test_columns_that_are_not_wanted_are_not_read():
    reader = audit.Reader(papers.AUDIT, True, {"datasets"})
    reader.scanner = reader.themes = reader.metrics = None  # nothing of these is asked
    assert reader.read("t", "We use the KITTI dataset. " * 5) == {"datasets": ["KITTI"]}


def test_wanted_columns_are_those_of_whole_records(spark):
    whole = {r["paper_id"]: r for r in papers.records(spark, DATA).collect()}
    for only in (("datasets",), ("themes", "fulltext_sha256"), papers.GATE, ("abstract_excerpt", "ablation_evidence")):
        rows = papers.records(spark, DATA, only).select("paper_id", *only).collect()
        assert len(rows) == len(whole) and all(r[c] == whole[r["paper_id"]][c] for r in rows for c in only)


def test_files_are_found_as_sparks_reader_finds_them_without_a_list_on_the_driver(spark, tmp_path):
    names = ["1_A b%20c+d/text.txt", "7/2_Ä_é/more/text.txt", "7/.hidden/3_x/text.txt", "_tmp/4_x/text.txt", "_k=1/5_x/text.txt", "7/6_x/note.md", "8_x/_text.txt", "top.txt", "9_e/empty.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if "empty" in n else n.encode() + b"\xff")
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path))
    want = sorted((r["path"], bytes(r["content"] or b"")) for r in own.select("path", "content").collect())
    found = corpus.files(spark, str(tmp_path), "*.txt")
    rows = sorted((r["path"], bytes(r["content"])) for r in found.collect())
    assert [r for r in rows if r[1]] == want and len(want) == 4
    assert [r[0].rpartition("/")[2] for r in rows if not r[1]] == ["empty.txt"]  # which Spark's reader passes over
    assert "binaryFile" not in found._jdf.queryExecution().toString()


def test_tasks_of_a_scan_do_not_grow_with_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i % 9}/{i}_x").mkdir(parents=True)
        (tmp_path / f"{i % 9}/{i}_x/text.txt").write_bytes(b"x")
    found = corpus.text_files(spark, str(tmp_path))
    assert found.count() == 300 and found.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism
    work.remove_spread(spark, str(tmp_path))
    assert not tmp_path.exists()


def test_registries_are_dealt_before_anything_is_sorted(spark):
    found = [f(runs(spark)) for f in (ledger.duplicate_runs, ledger.late_baselines, ledger.scopes_without_baseline)]
    for df in found:
        below = df._jdf.queryExecution().sparkPlan().toString().rpartition("RepartitionBy")[2] if "RepartitionBy" in df._jdf.queryExecution().sparkPlan().toString() else df._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning")[2]
        assert below and "Sort" not in below and "Aggregate" not in below and "WindowGroupLimit" not in below


def test_starts_of_single_precision_rows_are_those_of_double_ones():
    x = np.random.default_rng(1).standard_normal((500, 6)).astype(np.float32)
    assert (strata.mini_batches(x, 4, 20, 32, 7) == strata.mini_batches(x.astype(np.float64), 4, 20, 32, 7)).all()


def test_a_start_never_holds_all_rows_in_double_precision():
    import tracemalloc

    x = np.random.default_rng(1).standard_normal((60_000, 64)).astype(np.float32)
    tracemalloc.start()
    strata.mini_batches(x, 4, 5, 64, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes


def test_no_rules_keep_every_row(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert rules.clean(docs, rules=(), base=()).count() == 2
    assert [(r["base_failed"], list(r["failed"]), r["kept"]) for r in rules.judged(docs, (), ()).collect()] == [(False, [], True)] * 2
