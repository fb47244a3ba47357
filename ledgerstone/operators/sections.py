"""Section parser: a scanner that finds the first plausible heading of each section, and slices between headings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXPECTED_SECTIONS, SECTION_PATTERNS
from ..functions.lexicon import Finder, fold
from ..functions.rows import by_row
from ..functions.text import strip

HEADING = 100  # characters that a heading's line may have
PLACES = ("array<struct<start:int,name:string>>", pa.list_(pa.struct([("start", pa.int32()), ("name", pa.string())])))


def needle(pattern: str) -> str | None:
    """The longest run of letters and spaces that whatever matches the pattern holds in lower case; None if that can't be told."""
    if "|" in pattern or "[" in pattern:
        return None
    sure = re.sub(r"\\.", "\n", re.sub(r"\([^()]*\)[?*]|\\?.[?*]", "\n", pattern))
    runs = re.findall("[a-z]+(?: [a-z]+)*", "\n".join(x for x in re.split(r"[()]|\?:", sure)))
    longest = max(runs, key=len, default="")
    return longest if len(longest) > 2 else None


class Scanner:
    """Headings of texts in one pass: the needles of all patterns are sought in the text, and only short lines that hold one are held against patterns.

    A pattern may begin on a line and end on the next; a heading is where its match begins.
    """

    def __init__(self, patterns=None, strict=False):
        patterns = patterns or SECTION_PATTERNS
        self.sections = [(name, [(p, needle(p), re.compile(p, re.I), re.compile(rf"[\s\d.IVX]*{p}", re.I) if strict else None) for p in options]) for name, options in patterns.items()]
        every = [p for options in patterns.values() for p in options]
        found = [needle(p) for p in every]
        self.finder = None if None in found else Finder(found, lambda text, start, end: True)

    def lines(self, text: str):
        """(start, end) of the lines that may hold a heading, in order. All of them, if a pattern has no needle."""
        if self.finder is None:
            at = 0
            for line in text.split("\n"):
                yield at, at + len(line)
                at += len(line) + 1
            return
        seen = set()
        start = end = -1
        for first, last, _ in self.finder.hits(fold(text)):
            # A match may have begun on the line before.
            if not start <= first <= last <= end:
                start, end = text.rfind("\n", 0, first) + 1, text.find("\n", last)
                end = len(text) if end < 0 else end
                before = text.rfind("\n", 0, start - 1) + 1 if start else 0
                seen.update({(before, start - 1), (start, end)} if start else {(start, end)})
        yield from sorted(seen)

    def headings(self, text: str) -> list[dict]:
        """start, name by start: for each section the first line of HEADING characters or less on which its first pattern with any such line begins."""
        first = {}
        for start, end in self.lines(text):
            line = text[start:end]
            if len(line.strip()) > HEADING:
                continue
            stop = text.find("\n", end + 1) if end < len(text) else end
            both = text[start : len(text) if stop < 0 else stop]
            low = fold(both)
            for _, options in self.sections:
                for p, held, sought, leading in options:
                    if p not in first and (held is None or held in low) and (m := sought.search(both)) and m.start() < len(line) and (leading is None or leading.match(both)):
                        first[p] = start + m.start()
        found = [(next(first[p] for p, *_ in options if p in first), name) for name, options in self.sections if any(p in first for p, *_ in options)]
        return [{"start": at, "name": name} for at, name in sorted(found)]


def headings(text: Column, patterns=None, strict=False) -> Column:
    """array of start, name, by start, of a text. strict: only lines that begin with the heading, after numbering, count. Null texts have none."""
    scanner = Scanner(patterns, strict)
    return by_row(lambda t: scanner.headings(t or ""), *PLACES)(text)


def slices(text: str, heads: list[dict]) -> dict[str, str]:
    """What sections() has of a text."""
    if not heads:
        return {"full": text}
    ends = [h["start"] for h in heads[1:]] + [len(text)]
    cut = {h["name"]: text[h["start"] : end].strip() for h, end in zip(heads, ends) if end > h["start"]}
    return cut | ({"front_matter": text[: heads[0]["start"]].strip()} if heads[0]["start"] else {})


def sections(text: Column, heads: Column) -> Column:
    """name -> text. heads: what headings() gives of the same text, best as a column of its own."""
    end = F.length(text)
    cut = F.transform(
        heads,
        lambda x, i: F.struct(x["name"].alias("name"), strip(F.substring(text, x["start"] + 1, F.coalesce(F.get(heads, i + 1)["start"], end) - x["start"])).alias("text"), (F.coalesce(F.get(heads, i + 1)["start"], end) > x["start"]).alias("some")),
    )
    cut = F.transform(F.filter(cut, lambda x: x["some"]), lambda x: F.struct(x["name"].alias("key"), x["text"].alias("value")))
    first = F.get(heads, F.lit(0))["start"]
    front = F.array(F.struct(F.lit("front_matter").alias("key"), strip(F.substring(text, F.lit(1), first)).alias("value")))
    full = F.array(F.struct(F.lit("full").alias("key"), text.alias("value")))
    return F.map_from_entries(F.when(F.size(heads) == 0, full).when(first > 0, F.concat(cut, front)).otherwise(cut))


def share(parsed: dict[str, str], expected=EXPECTED_SECTIONS) -> float:
    """What coverage() has of a text's sections."""
    return sum(n in parsed for n in expected) / float(len(expected))


def coverage(parsed: Column, expected=EXPECTED_SECTIONS) -> Column:
    return F.size(F.array_intersect(F.map_keys(parsed), F.array(*map(F.lit, expected)))) / float(len(expected))
