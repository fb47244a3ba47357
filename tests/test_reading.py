"""One-pass reading of texts against plain, slow definitions of the same."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerstone.config import SECTION_PATTERNS, Audit, Role, roles
from ledgerstone.functions import extract, lexicon, text
from ledgerstone.operators import sections
from ledgerstone.plans import audit

LETTERS = st.text(alphabet="aAbB -_\n.éÉİσςΣ1", max_size=60)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.lists(st.text(alphabet="abAB -é1.", min_size=1, max_size=5), min_size=1, max_size=4))
def test_themes_count_what_patterns_find(raw, phrases):
    want = {}
    for p in {" ".join(text.phrase_words(lexicon.fold(p))): p for p in phrases if text.phrase_words(p)}.values():
        body = text.WORD_GAP.join(re.escape(w) for w in text.phrase_words(lexicon.fold(p)))
        want[p] = len(re.findall(f"{text.NOT_BEFORE}{body}{text.NOT_AFTER}", lexicon.fold(raw)))
    assert lexicon.Themes({"t": tuple(phrases)}).scores(lexicon.fold(raw)) == {"t": sum(want.values())}


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.text(alphabet="abé1", min_size=1, max_size=3))
def test_names_are_found_between_edges(raw, name):
    assert lexicon.Names((name,)).found(raw) == ([name] if re.search(f"{text.NOT_BEFORE}{re.escape(lexicon.fold(name))}{text.NOT_AFTER}", lexicon.fold(raw)) else [])
    assert lexicon.Names((name,), False, lexicon.word_edges).found(raw) == ([name] if re.search(rf"\b{re.escape(name)}\b", raw) else [])


def test_folding_keeps_places():
    for raw in ("ΑΣ ας", "İi", "ſK", "Straße", "ǅ"):
        assert len(lexicon.fold(raw)) == len(raw)
    assert lexicon.fold("ΑΣ") == lexicon.fold("ας") and lexicon.fold("ſ") == "s" and lexicon.fold("İ") == "i"


def test_records_with_ten_thousand_phrases_cost_less_than_twice_what_ten_do():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    raw = ". ".join(f"A{' '.join(word() for _ in range(12))}" for _ in range(700))
    few, many = (audit.Reader(Audit({str(i): tuple(f"{word()} {word()}" for _ in range(n // 10)) for i in range(10)}), True) for n in (10, 10_000))

    def took(reader):
        reader.read("t", "warm")
        times = []
        for _ in range(9):
            began = time.perf_counter()
            reader.read("t", raw)
            times.append(time.perf_counter() - began)
        return min(times)

    assert took(many) < 2 * took(few)


LINES = ["Abstract", "ABSTRACT.", "1.", "1", "Introduction", "1 Introduction", "  related work  ", "We propose a method", "x" * 101 + " method", " " * 150 + "Methodology", "background", "Experiments and results", "experimental results", "Proposed   method", "proposed method", "unabstracted", "conclusions", "références references", "", "limitation of it", "a discussion\tof", "text " * 30]


def every_line(raw, strict=False):
    """Each pattern held against each short line and the next."""
    rows, at, first = raw.split("\n"), 0, {}
    for i, line in enumerate(rows):
        both = "\n".join(rows[i : i + 2])
        for options in SECTION_PATTERNS.values():
            for p in options:
                m = re.search(p, both, re.I)
                if p not in first and m and m.start() < len(line) and len(line.strip()) <= sections.HEADING and (not strict or re.match(rf"[\s\d.IVX]*{p}", both, re.I)):
                    first[p] = at + m.start()
        at += len(line) + 1
    found = {name: next((first[p] for p in options if p in first), None) for name, options in SECTION_PATTERNS.items()}
    return sorted((at, name) for name, at in found.items() if at is not None)


@pytest.mark.parametrize("strict", [False, True])
def test_scanner_finds_what_every_line_and_pattern_give(strict):
    rng, scanner = random.Random(3), sections.Scanner(strict=strict)
    for _ in range(1500):
        raw = "\n".join(rng.choices(LINES, k=rng.randint(0, 12)))
        assert [(h["start"], h["name"]) for h in scanner.headings(raw)] == every_line(raw, strict), raw


def test_patterns_without_a_needle_are_held_against_all_short_lines():
    scanner = sections.Scanner({"a": (r"\bx|y\b",), "b": (r"\d+",)})
    assert scanner.finder is None and scanner.headings("no\nx 12") == [{"start": 3, "name": "a"}, {"start": 5, "name": "b"}]
    assert sections.needle(r"\bcolou?r tests?\b") == "r test" and sections.needle("[ab]cde") is None and sections.needle(r"\bab\b") is None


def test_a_line_of_megabytes_is_read_in_one_pass():
    raw = "method abstract introduction " * 100_000
    began = time.perf_counter()
    assert sections.Scanner().headings(raw + "\nAbstract\n" + raw) == [{"start": len(raw) + 1, "name": "abstract"}]
    assert time.perf_counter() - began < 20


def test_heaps_pick_what_sorting_all_would():
    rng = random.Random(9)
    wanted = tuple(Role(f"r{i}", (), tuple(rng.sample(["alpha", "beta", "we ", "gam"], 2)), 0, rng.randint(1, 4), i % 2 == 0) for i in range(5))
    for _ in range(200):
        said = [" ".join(rng.choices(["Alpha", "beta,", "we", "our", "gamma", "5.5", "plain", "BETA."], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 30))]
        got = extract.Scorer(wanted).best(said)
        for role, mine in zip(wanted, got):
            scored = []
            for i, s in enumerate(said):
                low = s.lower()
                score = sum(10_000 for p in role.phrases if p in low) + (15_000 if role.number_bonus and "5.5" in s else 0) + (2_000 if re.search("(we|our) ", low) else 0) - 5 * i
                if score > 0:
                    scored.append((-score, len(s), i))
            out, keys = [], set()
            for _, _, i in sorted(scored):
                key = re.sub(r"\W+", " ", said[i].lower())[:160]
                if key not in keys and len(out) < role.cap:
                    keys.add(key)
                    out.append(said[i])
            assert mine == out


def test_python_twins_agree_with_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    parts = ["A b.", " C", "\r\n", "\n\n\n", "-\nx", "-\nX", "\t \t", "\x00", " ", "é. 9", "• ", "\x1c", "abc" * 20 + ". ", "\n"]
    raws = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in raws], "x string").select("x", text.clean(F.col("x")).alias("c"), text.sentences(F.col("x"), 5, 600).alias("s"))
    for r in df.collect():
        assert text.cleaned(r["x"]) == r["c"] and extract.sentences_in(r["x"], 5) == r["s"], r["x"]
    heads = sections.headings(F.col("x"))
    for r in spark.createDataFrame([("\n".join(rng.choices(LINES, k=8)),) for _ in range(100)], "x string").select("x", heads.alias("h")).select("x", "h", sections.sections(F.col("x"), F.col("h")).alias("s")).collect():
        assert sections.slices(r["x"], [h.asDict() for h in r["h"]]) == r["s"]


def test_records_of_nulls_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "t", ""), (3, "The T", "Abstract\nThe method of it is here for all of us to see.")], "doc_id long, title string, text string")
    found = {r["paper_id"]: r for r in audit.records(docs, Audit({"t": ("the",)}, {n.name: ("method",) for n in roles({})})).collect()}
    assert [found[i]["word_count"] for i in (1, 2, 3)] == [0, 0, 13] and found[1]["fulltext_sha256"] is None
    assert found[1]["section_names"] == ["full"] and found[3]["section_names"] == ["abstract", "method"] and found[3]["theme_scores"] == {"t": 2} and found[3]["themes"] == ["t"]
    assert found[1]["theme_scores"] == {"t": 0} and found[2]["main_results"] == []
