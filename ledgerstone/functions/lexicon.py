"""All phrases of a lexicon found in one pass over a text, by an Aho-Corasick automaton, whatever their number."""

from __future__ import annotations

import re

import ahocorasick

from .text import phrase_words

ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
GAPS = "\t\n\x0b\x0c\r_-"
# Letters that are the same as another in any case, though lower case leaves them apart (final sigma, long s and the like).
TWINS = {c: ord(chr(c).upper().lower()) for c in range(0x80, 0x2000) if len(chr(c).upper().lower()) == 1 and chr(c).lower() == chr(c) != chr(c).upper().lower()}
TWIN = re.compile(f"[{''.join(map(chr, TWINS))}]")


def fold(text: str) -> str:
    """The text without case, of the same length."""
    if text.isascii():
        return text.lower()
    low = text.replace("İ", "i").lower()
    return low.translate(TWINS) if TWIN.search(low) else low


def even_gaps(text: str) -> str:
    """Every run of blanks, hyphens and underscores as one space."""
    for c in GAPS:
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def no_guard(text: str, start: int, end: int) -> bool:
    """Neither an ASCII letter nor a digit stands before start or at end."""
    return (not start or text[start - 1] not in ALNUM) and (end == len(text) or text[end] not in ALNUM)


def word_edges(text: str, start: int, end: int) -> bool:
    """Words begin or end at both places: of the two characters at each, one is of a word and one isn't."""
    return all((i > 0 and is_word(text[i - 1])) != (i < len(text) and is_word(text[i])) for i in (start, end))


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """An automaton over strings. It travels as the strings, and each task builds it once."""

    def __init__(self, keys, edges=no_guard):
        self.keys, self.edges, self.machine = list(dict.fromkeys(k for k in keys if k)), edges, None

    def __reduce__(self):
        return Finder, (self.keys, self.edges)

    def hits(self, text: str):
        """(start, end, key number), by end, of all occurrences that stand between edges."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, k in enumerate(self.keys):
                self.machine.add_word(k, i)
            self.machine.make_automaton()
        edges, sizes = self.edges, [len(k) for k in self.keys]
        for last, i in self.machine.iter(text) if self.keys else ():
            start = last + 1 - sizes[i]
            if edges(text, start, last + 1):
                yield start, last + 1, i

    def counts(self, text: str) -> dict[str, int]:
        """How often each key that occurs does, from the left, not overlapping itself."""
        free, found = {}, {}
        for start, end, i in self.hits(text):
            if start >= free.get(i, 0):
                free[i] = end
                found[i] = found.get(i, 0) + 1
        return {self.keys[i]: n for i, n in found.items()}

    def present(self, text: str) -> set[str]:
        return {self.keys[i] for _, _, i in self.hits(text)}


class Themes:
    """Counts of a lexicon's phrases by theme: phrases that differ in case or gaps only are one of a theme; a phrase without words counts nowhere."""

    def __init__(self, lexicon: dict[str, tuple[str, ...]]):
        self.names, self.of = tuple(lexicon), {}
        for theme, phrases in lexicon.items():
            for key in {" ".join(phrase_words(fold(p))) for p in phrases} - {""}:
                self.of.setdefault(key, []).append(theme)
        self.finder = Finder(self.of)

    def scores(self, text: str) -> dict[str, int]:
        """text: folded."""
        found = dict.fromkeys(self.names, 0)
        for key, n in self.finder.counts(even_gaps(text)).items():
            for theme in self.of[key]:
                found[theme] += n
        return found


class Names:
    """Which of a list of names stand in a text between edges, in their order."""

    def __init__(self, names, any_case=True, edges=no_guard):
        self.names, self.any_case = tuple(names), any_case
        self.finder = Finder((fold(n) if any_case else n for n in self.names), edges)

    def found(self, text: str, folded: str | None = None) -> list[str]:
        """folded: fold(text), if it is at hand."""
        if not self.names:
            return []
        there = self.finder.present((fold(text) if folded is None else folded) if self.any_case else text)
        return [n for n in self.names if (fold(n) if self.any_case else n) in there]
