"""What findings of round 4 were about."""

import duckdb
import pyarrow as pa
from helpers import DATA, same_rows

from ledgerstone.operators import select, strata
from ledgerstone.plans import audit, catalog, whole
from ledgerstone.sources import corpus, work


def test_names_after_the_beginning_of_a_text_and_beyond_thirty_count(spark, tmp_path):
    late = "x " * 70_000 + "We use the Zulu dataset."
    many = " ".join(f"the {c}{d}a dataset" for c in "ABCDEFGHIJ" for d in "bcde") + " and the Zulu benchmark, KITTI"
    docs = spark.createDataFrame([(11 * i, "s", t) for i, t in enumerate([late, late, many, many, "", None], 1)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalog.QUERIES["top_datasets"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("Zulu", 4), ("Aba", 2), ("Aca", 2), ("Ada", 2)]
    assert same_rows(found, con, catalog.ORACLES["top_datasets"]) == 4


def test_papers_go_through_files_some_at_a_time(spark, tmp_path):
    rows = [(f"{i}_x", f"t{i}".encode()) for i in range(450)] + [("7_x", b"again"), ("450_y", None)]
    raw = spark.createDataFrame(rows, "folder string, content binary").coalesce(1)

    def counted(batches):
        for _ in batches:
            yield pa.record_batch({"n": pa.array([sum(f.name == "text.txt" for f in tmp_path.rglob("*"))])})

    found = corpus.through_files(raw, str(tmp_path))
    assert sorted((r["path"].split("/")[-2], bytes(r["content"])) for r in found.collect()) == sorted((f, c or b"") for f, c in rows)
    seen = [r["n"] for r in found.mapInArrow(counted, "n long").collect()]
    assert seen and max(seen) <= corpus.HELD and not list(tmp_path.iterdir())


def test_audits_hold_neither_a_corpus_of_files_nor_records_twice(spark, tmp_path, monkeypatch):
    peak, sizes, old = [], {}, work.materialise

    def watched(df, tag, *compression):
        out = old(df, tag, *compression)
        peak.append((tag, sum(1 for _ in (tmp_path / "ledgerstone").rglob("text.txt"))))
        sizes[tag] = (out.columns, [p.split("-")[0] for p in (f.name for f in (tmp_path / "ledgerstone").iterdir())])
        return out

    for module in (whole, audit, strata, select):
        monkeypatch.setattr(module, "materialise", watched)
    monkeypatch.setattr(work, "shared_dir", lambda spark: f"file://{tmp_path}")
    found = {r["name"]: r["value"] for r in whole.audit_first(spark, DATA).collect()}
    assert found["scores_that_differ"] == 0 and found["selected"] == found["ids"] == 60
    assert all(n == 0 for _, n in peak)
    assert "text" not in sizes["scanned"][0] and "main_results" not in sizes["scored"][0]
    assert not {"scanned", "weights", "vectors"} & set(sizes["scored"][1])


def test_a_text_is_blank_if_nothing_but_blanks_is_in_it(spark):
    rows = [(1, "t", " \n\x1c "), (2, "t", ""), (3, "t", " \n."), (4, "\t", "x"), (5, "t", None)]
    good, bad = corpus.dead_letters(spark.createDataFrame(rows, "doc_id long, title string, text string").selectExpr("*", "string(doc_id) AS source_path"))
    assert [r["doc_id"] for r in good.collect()] == [3]
    assert {r["source_path"]: r["error"] for r in bad.collect()} == {"1": "empty text", "2": "empty text", "4": "no title", "5": "no text"}


def test_records_are_not_shuffled_for_the_few_that_are_picked(spark):
    parsed = work.materialise(spark.range(5000).selectExpr("id AS paper_id", "repeat('x', 500) AS main_results"), "parsed")
    picked = spark.range(0, 5000, 1000).selectExpr("id AS paper_id", "id AS selected_rank")
    found = audit.with_records(parsed, picked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["paper_id", "main_results", "selected_rank"] and found.count() == 5
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
