"""PII, language, toxicity, chat: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from ledgerstone.llm import chat, langid, pii, toxicity

ODD = [(1, None, "x"), (None, "", "y"), (None, "", "y"), (2, "word " * 30000, None), (3, "😀 \u0000 ١٢٣", "z"), (4, "...", None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


# --- personal data ---------------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for i, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15
            if not bad:
                out.append((i, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    for alphabet in ("a1 .@-+()2507", "0123456789 -.", "a@.b%"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert plain(text) == pii.base_spans(text), text


def test_best_segmentation_is_the_best_of_all():
    field = pii.trained()
    for text, _ in pii.generated(5, 60):
        toks = pii.tokens(text, 0, len(text))
        segs = [(i, j, k, field.score(f)) for i, j, k, f in pii.segments(text, toks)]
        if len(segs) > 12:
            continue
        best = 0.0
        for n in range(len(segs) + 1):
            for pick in itertools.combinations(segs, n):
                pick = sorted(pick)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(pick)):
                    joins = sum(a[1] == b[0] for a, b in itertools.pairwise(pick))
                    best = max(best, sum(p[3] for p in pick) + joins * field.weights.get(field.JOIN, 0.0))
        got = field.best(text, toks)
        at = {(k, toks[i][0], toks[j - 1][1]): (i, j, s) for i, j, k, s in segs}
        chosen = [at[g] for g in got]
        joins = sum(a[1] == b[0] for a, b in itertools.pairwise(chosen))
        assert math.isclose(sum(c[2] for c in chosen) + joins * field.weights.get(field.JOIN, 0.0), best, abs_tol=1e-9)


def test_field_on_new_zones():
    field, hit, wrong, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.generated(77, 300):
        got = {(pii.KINDS[k], a, b) for k, a, b in pii.find(text, field)[1]}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_field_parts_runs_of_numbers():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    base, spans = pii.find(text, pii.trained())
    assert base == [] and [text[a:b] for _, a, b in spans] == ["4524132264652876", "+1 (269) 555-3296"]


def test_bare_phones_need_a_cue():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find(t, pii.trained())[1]]
    assert found("call 269 555 3296 now") == [("phone", "269 555 3296")] == found("my phone: 269 555 3296.")
    assert found("of the 269 555 3296 that there are") == []


# Written by hand, not made by the generator: what stands in a sentence, and whether it is a span.
PLANTED = [
    ("You can reach us on (312) 555-0148 until five", "phone", "(312) 555-0148"), ("Rufen Sie +49 (30) 555-0199 an", "phone", "+49 (30) 555-0199"), ("Fax 646-555-0173 for orders", "phone", "646-555-0173"),
    ("mobile 503 555 0126 after six", "phone", "503 555 0126"), ("Llame al 213.555.0164 hoy", "phone", "213.555.0164"), ("write to ana.ruiz@correo.example.org please", "email", "ana.ruiz@correo.example.org"),
    ("mail jo [at] club [dot] org or come", "email", "jo [at] club [dot] org"), ("contact max(at)werk(dot)de soon", "email", "max(at)werk(dot)de"), ("the server 10.20.30.40 was down", "ip", "10.20.30.40"),
    ("paid with visa 4111 1111 1111 1111 at noon", "card", "4111 1111 1111 1111"), ("carte 5500-0000-0000-0004 refusée", "card", "5500-0000-0000-0004"), ("version 3.2.1 came out", None, None), ("on 2021-04-17 at 12:30", None, None),
    ("about 12,500 people in 1998", None, None), ("serial 4111111111111112 here", None, None), ("meet at noon at the mill", None, None), ("follow @river for more", None, None), ("ISBN 978-3-16 or so", None, None), ("chapters 3 to 14 of 20", None, None),
]


def test_hand_planted_spans_in_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 400").orderBy("doc_id").limit(3 * len(PLANTED)).collect()]
    field, hit, wrong, missed = pii.trained(), 0, 0, 0
    for i, body in enumerate(texts):
        said, kind, value = PLANTED[i % len(PLANTED)]
        cut = body.find(" ", 150)
        text = f"{body[:cut]} {said} {body[cut:]}"
        a, b = cut + 1, cut + 1 + len(said)
        got = {(pii.KINDS[k], text[s:e]) for k, s, e in pii.find(text, field)[1] if s >= a and e <= b}
        want = {(kind, value)} if kind else set()
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.9, (hit, wrong, missed)


def test_pii_query_matches_patterns(spark):
    """The query itself: counts, hash and column types against the plain patterns, and base spans among all spans."""
    found = pii.op3_pii(spark, DATA)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in found.collect():
        base = sorted(plain(texts[r["doc_id"]]))
        spelt = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelt).encode()).hexdigest() and set(spelt) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]


def test_pii_odd_rows(odd):
    got = pii.detect(odd).collect()
    assert len(got) == len(ODD) and all(r["spans"] == [] for r in got)
    assert pii.detect(odd.limit(0)).count() == 0


# --- language --------------------------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    length = np.array([300, 0, 5, 97, 96, 1])
    emit, move = rng.random((length.sum(), 3)) + 0.05, rng.random((3, 3)) + 0.1
    got, at = langid.marginals(emit, length, move), 0
    for n in length:
        x = emit[at : at + n]
        a, b, p, q = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3) / 3, np.ones(3)
        for t in range(n):
            p = (p @ move) * x[t]
            a[t] = p = p / p.sum()
        for t in range(n - 2, -1, -1):
            q = move @ (q * x[t + 1])
            b[t] = q = q / q.sum()
        want = a * b
        assert np.allclose(want / want.sum(1, keepdims=True), got[at : at + n], atol=1e-4)
        at += n


def test_languages_held_out_and_switching(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    crf = langid.train(docs, max_docs=400, sequences=1500)
    rows = langid.predict(docs, crf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    mixed = "the and that this with from " * 3 + "nicht der die und das mit " * 3
    found = [x for _, x in langid.Labeller(crf).words(mixed)]
    assert found[:18].count("en") > 14 and found[18:].count("de") > 14


def test_language_odd_rows(spark, odd):
    rows = langid.predict(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {(r["lang_pred"], r["score"]) for r in rows.collect()} == {("und", 0.0)}
    learned = odd.selectExpr("doc_id", "text", "'xx' lang")
    got = langid.predict(learned).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got} <= {"und", "xx"}
    assert langid.predict(learned.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    words = ["stupid", "idiot", "loser", "clown", "you"] + ["the", "and", "that", "with", "lost", "tides"] * 5
    return toxicity.CharModel(*toxicity.gram_counts([" ".join(rng.choice(words) for _ in range(600))]))


@pytest.mark.parametrize(("hidden", "word"), [("1d10t", "idiot"), ("st00pid", None), ("l0s3r", "loser"), ("looooser", "loser"), ("$tup!d", "stupid"), ("cl0wn", "clown")])
def test_decoding(model, hidden, word):
    got = toxicity.decode(hidden, model)
    assert got == word if word else got.startswith("st")


def test_restoring_leaves_plain_text(model):
    assert toxicity.restore("the lost tides, 2024", model) == "the lost tides, 2024"
    assert toxicity.restore("an i d i o t and c.l.o.w.n here", model) == "an idiot and clown here"


def way_score(model, word):
    history, total = 0, 0.0
    for c in word:
        step, history = model.step(history, toxicity.BOUND if c == " " else toxicity._CODE.get(c, toxicity.OTHER))
        total += step
    return total + model.step(history, toxicity.BOUND)[0]


def test_viterbi_is_the_best_reading(model):
    token = "1d10t"
    best = None
    for reading in itertools.product(*([x for x in toxicity.STANDS_FOR.get(c, c)] + ([""] if c in toxicity.STANDS_FOR else []) for c in token)):
        cost = sum(0.0 if c.isalpha() else -12.0 if r == "" else -1.0 - math.log(len(toxicity.STANDS_FOR[c])) for c, r in zip(token, reading, strict=True))
        best = max(best or (-math.inf, ""), (way_score(model, "".join(reading)) + cost, "".join(reading)))
    assert toxicity.decode(token, model) == best[1]


@pytest.mark.parametrize("stretch", ["y o u i d i o t", "i d i o t  u", "l.0.s.3.r", "t h e l o s t"])
def test_gaps_are_part_of_the_lattice(model, stretch):
    """Every way to read every character and every gap as nothing or as the end of a word."""
    ways = toxicity.spaced_lattice(stretch)
    assert sum([" ", 0.0] in map(list, w) or [" ", toxicity.PARTED] in map(list, w) for w in ways) == len(toxicity.GAP.findall(stretch))
    read = [("".join(r for r, _ in way), sum(c for _, c in way)) for way in itertools.product(*ways)]
    best = max(way_score(model, text) + cost for text, cost in read)
    got = toxicity.unspaced(stretch, model)
    assert any(abs(way_score(model, text) + cost - best) < 1e-6 for text, cost in read if text == got)


def test_words_are_cut_out_of_spaced_letters(model):
    assert toxicity.spaced_words("so y o u i d i o t, i d i o t  l o s e r and 1 2 3 4 5", model) == ["you", "idiot", "idiot", "loser"]


def test_conflicting_labels_agree_on_toxic(spark):
    docs = spark.createDataFrame([(i, f"some words that differ w{chr(97 + i % 26)} {'idiot' if i % 2 else 'fine'} x{chr(97 + i % 23)} and go on") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(60) for y in ((0, 1) if i % 2 else (0, 0))], "doc_id long, toxic int")
    rows = [toxicity.score(docs, labels.orderBy(order)).orderBy("doc_id").collect() for order in ("toxic", F.desc("toxic"))]
    assert rows[0] == rows[1] and all(r["predicted"] == r["doc_id"] % 2 for r in rows[0])


def test_held_out_toxicity(spark):
    folder = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(4)
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hit = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.85 and hit / sum(r["predicted"] for r in rows) > 0.9


def test_toxicity_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, none, keep=("score",)).collect()
    assert len(got) == len(ODD) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    kept = toxicity.reject(odd, some)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.reject(odd.limit(0), some).count() == 0


# --- chat ------------------------------------------------------------------------------------------------------------------------------


def test_chat_matches_sql(spark, duck):
    same_rows(chat.op6_chat(spark, DATA), duck, chat.ORACLE)


def test_layouts(spark):
    a = '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}'
    b = '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'
    c = '{"instruction":"add","input":"1 2","output":"3"}'
    rows = [(1, a), (2, b), (3, c), (4, '{"other":1}'), (5, "{"), (6, None), (7, '{"output":"3","input":"","instruction":"add"}')]
    got = chat.normalise(spark.createDataFrame(rows, "id long, record string")).collect()
    turns = {}
    for r in got:
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns[1] == [("user", "hi"), ("assistant", "")] and turns[2] == [("user", "hi"), ("assistant", "yo")]
    assert turns[3] == [("user", "add\n\n1 2"), ("assistant", "3")] and turns[7] == [("user", "add"), ("assistant", "3")]
    assert all(turns[i] == [(None, None)] for i in (4, 5, 6))


def test_escapes_round_trip():
    rng = random.Random(2)
    for _ in range(2000):
        parts = [rng.choice([*chat.CONTROL, chat.ESCAPE, "0", "A", "<", "|", "x\n", "é"]) for _ in range(rng.randint(0, 12))]
        text = "".join(parts)
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)
        formatted = chat.format_turn("user", text)
        assert chat.read_turns(formatted[0]) == [("user", text)] and chat.unescape(formatted[0][formatted[1] : formatted[2]]) == text


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "b"), (2, 5, "assistant", "x" * 100000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1 and got[2]["loss_chars"] == 100000
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_turns_are_stored_in_many_layouts(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "s"), ("user", "u </s>"), ("assistant", None), ("human", "h"), (None, "n"), ("user", "")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS `a.b`")
    held = chat.stored(turns).select(F.struct("conv_id", "turn").alias("at"), "record")
    found = chat.normalise(held, "at", "record")
    marks = {r["layout"] for r in found.select("layout").distinct().collect()}
    assert len(marks) >= 6 and marks <= set(chat.REGISTRY)
    back = found.select("conv_id.conv_id", "conv_id.turn", "role", "text").collect()
    assert sorted(map(tuple, back)) == sorted((c, t, r or "", x or "") for c, t, r, x in rows)


@pytest.mark.parametrize("text", ["½ ² Ⅷ", "42", "", "①②"])
def test_numerals_are_no_letters(text):
    assert langid.words_of(text) == []
    assert langid.words_of("ab½cd été") == ["ab", "cd", "été"]


def test_training_runs_come_from_whole_texts():
    runs = langid.drawn_runs("early " * 30000 + "late " * 30000, 5, 40, 24)
    assert len(runs) == 40 and all(4 <= len(r) < 24 for r in runs) and {"early", "late"} == {w for r in runs for w in r}
    assert runs == langid.drawn_runs("early " * 30000 + "late " * 30000, 5, 40, 24) and langid.drawn_runs("a b", 5, 40, 24) == []
    tokens, labels = langid.stitched([runs], np.zeros(1, int), 50, np.random.default_rng(0))
    assert all(len(t) == 24 for t in tokens) and "late" in str(tokens) and labels.shape == (50, 24)
