"""Lexicon scores, entities and evidence: array- and map-valued extractions that stay inside a row."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CODE_HOSTS, NOT_DATASETS, Role
from .lexicon import Names, Themes, fold, word_edges
from .rows import COUNTS, STRINGS, by_row
from .text import NUMBER_RESULT, TRIMMED


# A capitalised name before "dataset" or "benchmark", and a link with what is trimmed off its end.
NAMED = r"\b([A-Z][A-Za-z0-9+\-]{2,20})\s+(?:dataset|benchmark)\b"
LINK, LINK_TAIL = r"https?://[^\s\]\[)>(]+", ".,;"
NAMED_RE, LINK_RE, NUMBER_RE = (re.compile(p, re.ASCII) for p in (NAMED, LINK, NUMBER_RESULT))
DIGIT_RE = re.compile("[0-9]")  # no result number without one
END_RE, MARKS_RE = re.compile(r"(?<=[.!?]) (?=[A-Z0-9])"), re.compile(r"\W+")


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in the text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def substring_scores(title: Column, text: Column, lexicon: dict[str, tuple[str, ...]], most=30_000) -> Column:
    """Theme -> count of its words, inside other words too, in the title and the text's beginning."""
    hay = F.lower(F.concat(title, F.lit("\n"), F.substring(text, 1, most)))
    return F.create_map(*(x for theme, words in lexicon.items() for x in (F.lit(theme), sum((occurrences(hay, w.lower()) for w in words), F.lit(0)))))


def phrase_scores(title: Column, text: Column, lexicon: dict[str, tuple[str, ...]], most=50_000) -> Column:
    """Theme -> count of its phrases as whole words, by one automaton for all themes. Null texts have none."""
    themes = Themes(lexicon)
    return by_row(lambda hay: list(themes.scores(fold(hay or "")).items()), *COUNTS)(F.concat(title, F.lit("\n"), F.substring(text, 1, most)))


def active_themes(scores: Column) -> Column:
    """Themes with a score, best first, then by name."""
    found = F.filter(F.map_entries(scores), lambda e: e["value"] > 0)
    return F.transform(F.array_sort(F.transform(found, lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("name")))), lambda e: e["name"])


def named(text: str) -> list[str]:
    """Capitalised words before "dataset" or "benchmark"."""
    return NAMED_RE.findall(text) if "dataset" in text or "benchmark" in text else []


def ordered_names(known, near, stop, most) -> list[str]:
    return sorted({*known, *(t for t in near if t.lower() not in stop)}, key=lambda t: (t.lower(), t))[:most]


def dataset_names(text: Column, names, stop=NOT_DATASETS, most=30, any_case=True) -> Column:
    """Known names, and capitalised words before "dataset" or "benchmark"; by lower case, then value. Null texts have none."""
    known, stop = Names(names, any_case), frozenset(stop)
    return by_row(lambda t: ordered_names(known.found(t or ""), named(t or ""), stop, most), *STRINGS)(text)


def metric_names(text: Column, names, any_case=True) -> Column:
    """Which of the names stand in the text as words, in their order. Null texts have none."""
    known = Names(names, any_case, word_edges)
    return by_row(lambda t: known.found(t or ""), *STRINGS)(text)


def links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.rtrim(u, F.lit(LINK_TAIL)))


def code_links_in(text: str, hosts=CODE_HOSTS, most=12) -> list[str]:
    """What code_links() has of a text."""
    if "http" not in text:
        return []
    found = {u.rstrip(LINK_TAIL) for u in LINK_RE.findall(text)}
    return sorted(u for u in found if any(h in u.lower() for h in hosts))[:most]


def code_links(text: Column, hosts=CODE_HOSTS, most=12) -> Column:
    kept = F.filter(links(text), lambda u: F.regexp_like(F.lower(u), F.lit("|".join(map(re.escape, hosts)))))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, most)


# What a sentence scores, in ten-thousandths, so that sums are exact.
KEYWORD, NUMBER, PRONOUN, PLACE = 10_000, 15_000, 2_000, 5


class Scorer:
    """Scores of sentences for several roles at once: what a sentence holds is looked up once, whatever the number of roles."""

    def __init__(self, wanted: tuple[Role, ...]):
        self.roles = wanted
        self.phrases = list(dict.fromkeys(p.lower() for r in wanted for p in r.phrases))
        place = {p: i for i, p in enumerate(self.phrases)}
        self.of = [([place[p.lower()] for p in r.phrases], r.number_bonus, r.cap) for r in wanted]

    def best(self, said: list[str]) -> list[list[str]]:
        """For each role its best sentences: highest score first, shorter first, then in order; of those that differ in marks only the best. A heap gives as many as it takes, no more are sorted."""
        heaps = [[] for _ in self.of]
        for i, s in enumerate(said):
            low = s.lower()
            held = [p in low for p in self.phrases]
            base = (PRONOUN if "we " in low or "our " in low else 0) - i * PLACE
            number = None
            for heap, (own, bonus, _) in zip(heaps, self.of):
                score = base + KEYWORD * sum([held[k] for k in own])
                if bonus:
                    number = NUMBER * bool(DIGIT_RE.search(s) and NUMBER_RE.search(s)) if number is None else number
                    score += number
                if score > 0:
                    heap.append((-score, len(s), i))
        known = {}
        return [self.distinct(said, heap, cap, known) for heap, (_, _, cap) in zip(heaps, self.of)]

    def distinct(self, said, heap, cap, known):
        """known: keys of sentences by place, for all roles."""
        heapq.heapify(heap)
        keys, out = set(), []
        while heap and len(out) < cap:
            i = heapq.heappop(heap)[2]
            if i not in known:
                low = said[i].lower()
                key = MARKS_RE.sub(" ", low[:240])
                # What follows changes at most the last character of a beginning's key.
                known[i] = (key if len(key) > 160 or len(low) <= 240 else MARKS_RE.sub(" ", low))[:160]
            if known[i] not in keys:
                keys.add(known[i])
                out.append(said[i])
        return out


def sentences_in(text: str, least=35, most=600) -> list[str]:
    """What text.sentences() has of a text."""
    pieces = (s.strip(TRIMMED) for s in END_RE.split(" ".join(text.split())))
    return [s for s in pieces if least <= len(s) <= most]


def evidence(text: Column, role: Role) -> Column:
    """The role's best sentences of a text. Null texts have none."""
    scorer = Scorer((role,))
    return by_row(lambda t: scorer.best(sentences_in(t or ""))[0], *STRINGS)(text)
