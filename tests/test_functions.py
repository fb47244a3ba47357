import hashlib
import json
import math
import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from helpers import runs

from ledgerstone.config import Audit, Quota, Role, Weight
from ledgerstone.functions import extract, text
from ledgerstone.operators import ledger, leakage, quality, scan, sections, select, strata
from ledgerstone.plans import audit, registry
from ledgerstone.sources import corpus, sinks
from ledgerstone.streaming import registry_stream


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\r\nb", "a\n\nb"), ("a\x00\t\tb", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("exam-\nple", "example"), ("exam-\nPle", "exam-\nPle"), ("  a \n", "a"), ("", "")],
)
def test_clean(spark, raw, want):
    assert one(spark, text.clean, raw) == want


def test_counts(spark):
    assert one(spark, text.word_count, "a b\x1cc  d") == 4
    assert one(spark, text.word_count, " \n") == 0
    assert one(spark, text.char_count, "é😀") == 2


def test_sentences(spark):
    a, b, c, d = ("X" + "y" * (n - 2) + "." for n in (34, 35, 600, 601))
    assert one(spark, text.sentences, " ".join((a, b, c, d))) == [b, c]
    assert one(spark, text.sentences, f"{b} lower case goes on.") == [f"{b} lower case goes on."]
    assert one(spark, lambda x: text.sentences(x, 1), "Aa. 9. Bb. Cc") == ["Aa.", "9.", "Bb.", "Cc"]


def test_phrases(spark):
    words = {"t": ("low light",)}
    for raw, n in (("Low-light and low_light, low  light; lowlight slow light", 3), ("low light low light", 2)):
        assert one(spark, lambda x: extract.phrase_scores(F.lit(""), x, words), raw) == {"t": n}
    assert one(spark, lambda x: extract.substring_scores(F.lit(""), x, {"t": ("ct",)}), "object Act") == {"t": 2}
    words = {"t": ("low light", "light weight", "c++", "c", "sea")}  # some share words, so that their matches can overlap
    assert one(spark, lambda x: extract.phrase_scores(F.lit(""), x, words), "Low light weight, sea c++ C") == {"t": 6}
    assert one(spark, lambda x: extract.phrase_scores(F.lit(""), x, {"t": ("low light", "low-light", "-", "")}), "low light - low") == {"t": 1}


def test_entities(spark):
    raw = "We use coco and the KITTI dataset, The dataset, https://github.com/a/b., https://x.org/c, https://github.com/a/b"
    assert one(spark, lambda x: extract.dataset_names(x, ("COCO", "ImageNet")), raw) == ["COCO", "KITTI"]
    assert one(spark, extract.code_links, raw) == ["https://github.com/a/b"]
    many = " ".join(f"https://github.com/{i:02}" for i in range(13))
    assert len(one(spark, extract.code_links, many)) == 12
    assert one(spark, lambda x: extract.metric_names(x, ("mAP", "F1"), any_case=False), "a map of mAP") == ["mAP"]


def test_evidence(spark):
    pad = "with some more words to be long enough"
    raw = f"We propose a thing {pad}. Our result is 93.1% {pad}. We propose, a thing {pad}. Nothing is said here {pad}."
    got = one(spark, lambda x: extract.evidence(x, Role("r", (), ("propose",), 0, 3)), raw)
    assert [s.split(" with")[0] for s in got] == ["We propose a thing", "Our result is 93.1%"]
    bonus = one(spark, lambda x: extract.evidence(x, Role("r", (), ("propose",), 0, 1, True)), raw)
    assert bonus[0].startswith("Our result")


def parse(spark, raw, **options):
    df = spark.createDataFrame([(raw,)], "x string").withColumn("h", sections.headings(F.col("x"), **options))
    return df.select(sections.sections(F.col("x"), F.col("h"))).first()[0]


def test_sections(spark):
    assert parse(spark, "no headings here") == {"full": "no headings here"}
    got = parse(spark, "A title\nAbstract\nWe do.\n1.\nIntroduction\nText.\nMethod\nOurs.")
    assert got == {"front_matter": "A title", "abstract": "Abstract\nWe do.", "introduction": "1.\nIntroduction\nText.", "method": "Method\nOurs."}
    line = "method " + "x" * 93
    assert "method" in parse(spark, line) and "full" in parse(spark, line + "x")
    # A later match of an earlier pattern wins over an earlier match of a later one.
    assert parse(spark, "background\nrelated work")["related_work"] == "related work"
    assert "full" in parse(spark, "our method is good", strict=True)


def test_title(spark):
    got = spark.createDataFrame([("file:/r/12_A_good_title/x.txt",)], "p string").select(*text.title_from_path(F.col("p"))).first()
    assert tuple(got) == ("12", "A good title")


AUDIT = Audit(
    lexicon={"a": ("alpha",), "b": ("beta",)}, phrases={"method_claims": ("propose",), "experiment_protocol": ("evaluate",), "main_results": ("achieve",)}, direct=(Weight("a", 2.0, 3), Weight("b", 1.0)),
    quotas=(Quota("a", 2), Quota("b", 2)), target=6, strata=2, least_words=20, least_coverage=0.2,
)


def write_corpus(root, n=12):
    for i in range(n):
        folder = root / f"{i:03}_Paper_number_{i}"
        folder.mkdir(parents=True)
        body = f"Abstract\nWe propose alpha number {i} for things that are hard to do.\nMethod\nWe propose a new {'beta' if i % 2 else 'alpha'} machine with parts.\nExperiments\nWe evaluate it on the KITTI dataset with great care. We achieve {i}.5 points on the task at hand.\nConclusion\nIt works well."
        (folder / "text.txt").write_bytes(body.encode() + (b" \xff" if i == 0 else b""))


def test_audit_end_to_end(spark, tmp_path):
    write_corpus(tmp_path / "in")
    progress = Observation("scan")
    docs = corpus.unique_ids(corpus.at_least(corpus.text_files(spark, str(tmp_path / "in"), keep_bytes=True), 6)).cache()
    assert corpus.watched(docs, progress).count() == 12 and progress.get["rows"] == 12 and progress.get["damaged"] == 1
    assert docs.filter("not intact").count() == 1
    good, bad = corpus.dead_letters(docs)
    parsed = audit.records(good, AUDIT).cache()
    row = parsed.filter("paper_id = '001'").first()
    assert row["section_names"] == ["abstract", "conclusion", "experiments", "method"] and row["section_coverage"] == 0.8
    assert row["datasets"] == ["KITTI"] and row["themes"] == ["a", "b"] and row["main_results"]
    chosen = audit.v2(parsed, AUDIT, tries=2, rounds=20).cache()
    assert sorted(r["selected_rank"] for r in chosen.collect()) == list(range(1, 7))
    assert chosen.select("paper_id").distinct().count() == 6
    first = audit.v1(parsed, AUDIT, tries=2, rounds=20)
    assert sorted(r["selected_rank"] for r in first.collect()) == list(range(1, 7))
    (tmp_path / "out" / "old").mkdir(parents=True)
    found = sinks.write_outputs(parsed, chosen, docs, str(tmp_path / "out"), bad, AUDIT.quotas, 12, quality.directly_relevant(F.col("theme_scores"), strong=("b",)))
    assert not (tmp_path / "out/old").exists()
    assert found["selected"] == 6 and not found["human_reading_claimed"]
    assert spark.read.csv(str(tmp_path / "out/registry.csv"), header=True).columns == sinks.CSV_COLUMNS
    sums = [r["value"].split("  ") for r in spark.read.text(str(tmp_path / "out/checksums")).collect()]
    assert len(sums) == 6 and all(hashlib.sha256((tmp_path / "out" / name).read_bytes()).hexdigest() == want for want, name in sums)
    checked = json.loads((tmp_path / "out/quality.json").read_text())
    assert checked["selected"] == 6 and checked["quotas"] == {"a": 2, "b": 2} and checked["eligible"] == 12 and checked["word_count_least"] > 20
    direct = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/direct.jsonl")).collect()]
    assert direct and all("b" in r["themes"] for r in direct) and [r["selection_score"] for r in direct] == sorted((r["selection_score"] for r in direct), reverse=True)
    with pytest.raises(ValueError):
        audit.v1(parsed, replace(AUDIT, target=13), tries=1, rounds=5)
    assert (tmp_path / "out/summary.json").exists() and "Integrity" in (tmp_path / "out/report.md").read_text()


def test_guards(spark, tmp_path):
    write_corpus(tmp_path / "in", 2)
    (tmp_path / "in/000_Paper_number_0/more.txt").write_text("x")
    docs = corpus.text_files(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError):
        corpus.unique_ids(docs)
    with pytest.raises(ValueError):
        corpus.at_least(docs, 4)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.text_files(spark, str(tmp_path / "none")).count()


def test_registry_file(spark, tmp_path):
    path = str(tmp_path / "registry")
    sinks.init_registry(spark, path)
    assert ledger.schema_matches(corpus.registry(spark, path)) and corpus.registry(spark, path).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.init_registry(spark, path)
    sinks.init_registry(spark, path, force=True)


def test_append_only(spark):
    old = runs(spark)
    assert ledger.rewritten(old, old).count() == 0
    new = old.withColumn("primary_value", F.when(F.col("run_id") == "r3", "0.9").otherwise(F.col("primary_value")))
    assert [r["run_id"] for r in ledger.rewritten(old, new).collect()] == ["r3"]
    assert ledger.rewritten(old, new, ("r3",)).count() == 0


def test_stream(spark, tmp_path):
    runs(spark).coalesce(1).write.option("sep", "\t").option("header", "true").csv(str(tmp_path / "in"))
    rows = registry_stream.read(spark, str(tmp_path / "in"))
    assert rows.isStreaming and registry_stream.row_rules(rows).isStreaming
    registry_stream.watch(rows, str(tmp_path / "table"), str(tmp_path / "found"), str(tmp_path / "check")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "found")).select("campaign", "run_id", "rule", "detail")
    assert {r["rule"] for r in got.collect()} >= {"orphan_parent", "baseline_not_first"}


def test_round_robin_is_a_cursor_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(5)}", rng.randrange(4), float(rng.randrange(6)), ["a"]) for i in range(40)]
    got = [r["doc_id"] for r in select.round_robin(spark.createDataFrame(rows, "doc_id long, title string, stratum int, score double, themes array<string>"), 25).orderBy("step").collect()]
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1], r[0])):
        groups.setdefault(r[2], []).append(r[0])
    want, turn = [], 0
    while len(want) < 25:
        want += [groups[g][turn] for g in sorted(groups, key=lambda g: (-len(groups[g]), g)) if turn < len(groups[g])]
        turn += 1
    assert got == want[:25]


def test_v2_needs_enough_rows(spark):
    rows = spark.createDataFrame([(1, "t", 0, 1.0, ["a"])], "doc_id long, title string, stratum int, score double, themes array<string>")
    with pytest.raises(ValueError):
        select.v2_selection(rows, 2, ())


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "y int, s double")
    got = leakage.confusion(rows, "y", "s").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["f1"]) == (1, 1, 1, 1, 0.5)
    assert leakage.auroc(rows, "y", "s").first()[0] == 0.75
    gaps = leakage.generalisation_gap(spark.createDataFrame([("m", "train", 0.9), ("m", "test", 0.5)], "model string, split string, score double"), 0.2)
    assert gaps.first()["wide"]


def test_relevance_and_scores(spark):
    df = spark.createDataFrame([({"a": 5, "b": 0},), ({"a": 0, "b": 1},)], "m map<string,int>")
    got = df.select(quality.weighted(F.col("m"), AUDIT.direct), quality.capped_sum(F.col("m"), 3), quality.directly_relevant(F.col("m"), strong=("a",))).collect()
    assert [tuple(r) for r in got] == [(6.0, 3, True), (1.0, 1, False)]


def test_scans(spark):
    docs = spark.createDataFrame([(1, "We go. We see. They win.\n\nIn order to do so, in order to win.")], "doc_id long, text string")
    assert scan.phrase_scan(docs, {"padding": ("in order to",)}).first()["n"] == 2
    assert scan.repeated_openers(docs).first()["opener"] == "we"
    found = scan.phrase_scan(docs, {"padding": ("in order to",)})
    assert scan.new_findings(found, found).count() == 0


def test_other_ledgers(spark):
    routes = spark.createDataFrame([("t", "a"), ("t", ""), ("u", "a"), ("u", "b"), ("u", "c")], "topic string, idea string")
    assert {(r["topic"], r["rule"]) for r in ledger.check_routes(routes, ("idea",)).collect()} == {("t", "number_of_routes"), ("t", "empty_field")}
    aims = spark.createDataFrame([("c", True, True, None), ("d", True, False, "user_paused"), ("e", False, None, "tired")], "campaign string, target_met boolean, validated boolean, stop_reason string")
    assert [r["outcome"] for r in ledger.completion(aims, ("user_paused",)).orderBy("campaign").collect()] == ["complete", "user_paused", "target not met"]
    assert ledger.missing_items(aims, ("stop_reason",)).first()["campaign"] == "c"
    gates = spark.createDataFrame([("c", "metric", "maybe", True)], "campaign string, gate string, state string, applicable boolean")
    assert ledger.bad_states(gates, {"metric": ("passed", "failed")}).count() == 1
    kept = ledger.writing_controls(spark.createDataFrame([("methods", "bold"), ("intro", None)], "section string, risk_tolerance string"))
    assert [r["risk_tolerance"] for r in kept.collect()] == ["conservative", "balanced"]


def test_every_overlap_has_a_class(spark, tmp_path):
    texts = {1: "The same, text!", 101: "the  same text", 207: "THE SAME\ntext", 3: "other", 205: "Other.", 6: "alone", 7: None, 8: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["overlap_classes"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["first_id"], r["n"]) for r in got} == {(1, 1, 3), (101, 1, 3), (207, 1, 3), (3, 3, 2), (205, 3, 2)}
    assert len(got) == 5 and len({r["key"] for r in got}) == 2


def test_clusters_hold_their_invariants(spark):
    docs = spark.createDataFrame([(i, f"{'cat dog' if i % 2 else 'sun moon'} word{i % 3} word{i % 3}") for i in range(30)], "doc_id long, text string")
    weights = strata.tfidf(docs, "text")
    norms = weights.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 9).alias("n")).select("n").distinct().collect()
    assert [r["n"] for r in norms] == [1.0]
    found = strata.strata(docs, "text", 2, tries=3, rounds=20, dims=32)
    assert found.count() == 30 and found.select("cluster_id").distinct().count() == 2
    assert strata.largest_share(found).first()[0] < 0.9


def brute_tfidf(texts):
    """(id, term): weight, of texts small enough that every term fits."""
    held = {}
    for i, t in texts.items():
        w = re.findall(r"\b\w\w+\b", t.lower())
        held[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df, n, out = Counter(t for c in held.values() for t in c), len(texts), {}
    for i, c in held.items():
        raw = {t: (1 + math.log(tf)) * (1 + math.log((1 + n) / (1 + df[t]))) for t, tf in c.items() if 2 <= df[t] <= 0.92 * n}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, t): v / length for t, v in raw.items()}
    return out


def test_documents_have_weights_and_strata(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["Über", "cat", "dog", "a", "sun", "moon", "tree", "x1"]) for _ in range(rng.randint(3, 30))) for i in range(60)} | {60: "", 61: "nowhere else"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in registry.QUERIES["tfidf_documents"](spark, str(tmp_path)).collect()}
    want = brute_tfidf(texts)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    found = {r["doc_id"]: r["cluster_id"] for r in registry.QUERIES["semantic_strata"](spark, str(tmp_path)).collect()}
    assert found.keys() == texts.keys() and {i for i, c in found.items() if c == -1} == {60, 61} and len(set(found.values())) > 20
