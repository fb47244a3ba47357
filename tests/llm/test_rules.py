"""Quality rules, against SQL over whole tables and a direct count."""

import re
from collections import Counter

import pytest
from helpers import DATA, same_rows

from ledgerstone.llm import rules

SMALL = DATA.replace("0.001", "0.01")


def test_query_matches_sql(spark, larger):
    assert same_rows(rules.op11_quality(spark, SMALL), larger, rules.ORACLE) == 1000


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x y z w v u x y z w v q", "# * $ % & | < >", "l\nl\n\nl \n l\nl", "  \n  \n", "é ñ ü 日本 \U0001f600\U0001f600",
    "a b c d e f " * 3000, "w" * 50_000, "the cat and the dog\n" * 12, "nbsp is no blank   here", "A B C D E\nF G H I J", "- x\n- y\n- z\n* q\n• r", "so...\nand…\nthen...\nor... \nend...", "1 2 3 4 5 6 1 2 3 4 5",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_measures_match_a_direct_count(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, `a.b` int")
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert tuple(got[i][m] for m in rules.MEASURES[:5]) == want, t
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert got[i]["kept"] == (not got[i]["failed"]) and (not got[i]["base_failed"] or not got[i]["kept"])
    assert got[17]["n_bullet_lines"] == 5 and got[18]["n_ellipsis_lines"] == 5


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("Plain words of the text that are here for us to read and to keep as they are", None),
        ("one | two | three | four | five | six | seven | eight | nine | ten", "letters"),
        ("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN", "upper"),
        ("one*** two*** three*** four*** five*** six*** seven*** eight*** nine*** ten***", "symbols"),
        (" ".join(f"w{i}x" for i in range(200)), "stop_words"),
        ("here it is\nhere it is\n" + "\n".join(f"{w} and the {w * 2}" for w in "red blue green dark light warm cold".split()), None),
        ("\n".join(["the same line of it"] * 4 + [f"another {i} of them" for i in range(5)]), "dup_lines"),
        ("中文 " * 3 + "一二三 四五六 七八九 十 百 千 万", None),
    ],
)
def test_rules_of_the_table(spark, text, rule):
    row = rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (rule in row["failed"]) if rule else row["kept"], row


def test_good_texts_stay_and_labels_agree(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = rules.judged(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_repeats_nulls_extra_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "k"), (3, None, 2, "k"), (3, None, 2, "k")], "doc_id long, text string, n_words int, `row` string")
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in rules.judged(docs).collect()) == [(0, 2, False), (3, 0, False), (3, 0, False)]
    assert rules.judged(docs.limit(0)).count() == 0
    every = rules.clean(docs, rules=(), base=())
    assert every.columns == docs.columns and every.count() == 3 and rules.clean(docs).count() == 0
    table = (rules.Rule("long", "n_words", most=1),)
    assert [r["failed"] for r in rules.judged(docs, table, ()).orderBy("n_words").collect()] == [[], [], ["long"]]
