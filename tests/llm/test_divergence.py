"""Source divergence, against plain SQL over whole tables and a direct computation."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import DATA, same_rows

from ledgerstone.llm import divergence


def test_query_matches_sql(spark, duck):
    assert same_rows(divergence.op13_divergence(spark, DATA), duck, divergence.ORACLE) > 1000


def test_small_chunks_and_joined_groups_match_sql(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert same_rows(divergence.diverge(docs, chunk=50, groups=0), duck, divergence.ORACLE) > 1000


ROWS = [
    ("The cat THE the Zoë zoë", "en", "a"), ("the cat sat", "en", "b"), ("THE CAT cat\x00cat", "en", "b"), ("the dog", "en", "c"), (None, "en", "d"), ("", "en", None), ("the the", "en", "a"), ("the the", "en", "a"),
    (None, None, None), ("one", "xx", "q"), (None, "xx", "r"), ("日本 日本-日本", "ja", "a"), ("日本", "ja", "b"), ("日本 \U0001f600", "ja", "b"), ("a" * 100_000 + " the", "en", "é"), ("the é É", "en", "z"), ("é dog", "en", "z"), ("dog é", "en", "Z"),
]


def brute(rows, least=3, top=200):
    docs = [(l or "", s or "", re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    held = defaultdict(Counter)
    for lang, _, words in docs:
        held[lang].update(set(words))
    out = []
    for lang in {d[0] for d in docs}:
        terms = [t for t, n in held[lang].items() if n >= least]
        count = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                count[source].update(w for w in words if w in set(terms))
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(terms))
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            lists = {"pair": [(sum(f(p(count[s], t), p(count[o], t)) for t in terms), o) for o in count if o != s], "term": [(f(p(count[s], t), p(whole, t)), t) for t in terms if count[s][t] and p(count[s], t) > p(whole, t)]}
            for part, found in lists.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "groups"), [(200_000, 100_000), (1, 100_000), (3, 0)])
def test_nulls_repeats_marks_and_scripts(spark, chunk, groups):
    docs = spark.createDataFrame([(*r, i, i) for i, r in enumerate(ROWS)], "text string, lang string, source string, term long, `a.b` long")
    got = sorted(tuple(r) for r in divergence.diverge(docs, chunk=chunk, groups=groups).collect())
    assert got == brute(ROWS) and {r[2] for r in got} == {"pair", "term"}
    few = sorted(tuple(r) for r in divergence.diverge(docs, least=1, top=2, chunk=chunk, groups=groups).collect())
    assert few == brute(ROWS, 1, 2)


def test_no_rows_and_counts_beyond_a_long(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.diverge(docs).count() == 0
    con = divergence.database()
    assert con.execute(f"SELECT {divergence.share('9000000000000', '18000000000000')}").fetchone()[0] == 1 + 10**9 * 9000000000001 // 18000000000000
    assert spark.sql(f"SELECT {divergence.spark_share('9000000000000L', '18000000000000L')}").first()[0] == 1 + 10**9 * 9000000000001 // 18000000000000
