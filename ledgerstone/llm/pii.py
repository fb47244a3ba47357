"""Personal data by a semi-Markov conditional random field.

Patterns find the plain cases. The field adds those that patterns get wrong because matches run into one another or
are written in other ways: whole-span features score candidate segments (digits and their grouping, check
digits, separators, words before), and dynamic programming over segments of bounded length picks
boundaries and kinds of a zone together. Weights maximise the conditional likelihood of generated zones.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Kinds in their order, and the patterns of the plain cases.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = {"phone": "phone tel telephone call mobile cell fax whatsapp téléphone telefon teléfono".split(), "card": "card visa mastercard amex credit debit carte karte tarjeta".split(), "ip": "ip host server address addr adresse".split(), "email": "mail email e-mail contact courriel correo".split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain cases, each kind leftmost and non-overlapping; matches that fail a kind's test are gone. Linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not re.search("[0-9]", text):
        return found
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(map(small, parts[i : i + 4])):
                found.append((1, start, start + size))
            start += size + 1
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


LONGEST, WIDEST, GROUPS = 15, 100, 6  # tokens and characters of a segment, and its runs of digits
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
ZONE = re.compile(r"[+(]*[0-9](?:[0-9().+/-]|[ \t]{1,2}(?=[0-9(+]))*|\S{0,64}@\S{0,64}|[\w.+-]{1,64} ?[\[({] ?at ?[\])}] ?[\w.-]{1,64}(?: ?[\[({] ?dot ?[\])}] ?[\w-]{1,32}){0,4}", re.IGNORECASE)
NUMERIC = re.compile(r"[+(]{0,2}[0-9][0-9\s().+/-]*[0-9]")
AT = re.compile(r"\s?(?:@|[\[({]\s?at\s?[\])}])\s?", re.IGNORECASE)
DOT = re.compile(r"\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?", re.IGNORECASE)
NAME = re.compile(r"[A-Za-z0-9_%+-]+")


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]


def kinds_of(s: str) -> list[str]:
    """The kinds a span may be of; none for most spans."""
    if "@" in s or "at" in s.lower():
        halves = AT.split(s)
        if len(halves) == 2 and all(halves):
            names = [DOT.split(h) for h in halves]
            if len(names[1]) > 1 and all(NAME.fullmatch(x) for h in names for x in h):
                return ["email"]
        return []
    if not NUMERIC.fullmatch(s):
        return []
    d = len(digits_of(s))
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        return ["ip"] + (["phone"] if 8 <= d else [])
    return (["phone"] if 7 <= d <= 15 else []) + (["card"] if 13 <= d <= 19 and not set(s) & set("+()./") else [])


def span_features(text: str, start: int, end: int, kind: str) -> list[str]:
    s = text[start:end]
    d = digits_of(s)
    groups = re.findall("[0-9]+", s)
    before = text[max(0, start - 24) : start]
    words = re.findall(r"[^\W\d_][\w-]*", before.lower())
    left, right = text[start - 1 : start], text[end : end + 1]
    out = [
        "bias",
        f"digits={len(d)}",
        f"shape={'-'.join(str(len(g)) for g in groups) if len(groups) <= 6 else 'many'}",
        f"separators={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', s)) & set(' ().+-/@')))}",
        f"plus={s[:1] == '+'}",
        f"nested={'+' in s[1:]}",
        f"brackets={s.count('(') == s.count(')')},{min(s.count('('), 2)}",
        f"left={'n' if left.isdigit() else 'a' if left.isalpha() else left if left in '.-/+@(' else 's'}",
        f"right={'n' if right.isdigit() else 'a' if right.isalpha() else right if right in '-/+@)' else 's'}",
        *(f"cue={k}" for k, names in CUES.items() if set(words[-2:]) & set(names)),
    ]
    if kind == "card":
        out += [f"luhn={luhn(d)}", f"first={d[:1]}", f"even={len(set(map(len, groups))) == 1}"]
    if kind == "ip":
        out.append(f"small={all(map(small, groups))}")
    if kind == "phone":
        out.append(f"whole={len(groups) == 1},{s[:1] == '+'}")
    if kind == "email":
        out.append(f"plain={'@' in s}")
    return [f"{kind}:{f}" for f in out]


def segments(text: str, toks: list[tuple[int, int]]):
    """(first token, token after, kind, features) of every candidate."""
    for i in range(len(toks)):
        head = text[toks[i][0]]
        if not (head.isalnum() or head in "+("):
            continue
        groups = 0
        for j in range(i + 1, min(len(toks), i + LONGEST) + 1):
            groups += "0" <= text[toks[j - 1][0]] <= "9"
            if groups > GROUPS or toks[j - 1][1] - toks[i][0] > WIDEST:
                break
            for kind in kinds_of(text[toks[i][0] : toks[j - 1][1]]):
                yield i, j, kind, span_features(text, toks[i][0], toks[j - 1][1], kind)


class Field:
    """Segments have kinds or are single tokens outside; JOIN weighs two spans that touch."""

    JOIN = "join"

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, found: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in found)

    def best(self, text: str, toks) -> list[tuple[str, int, int]]:
        """The likeliest segmentation: states are whether the last token was outside (0) or in a span (1)."""
        n = len(toks)
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, kind, found in segments(text, toks):
            ending[j].append((i, kind, self.score(found)))
        if not any(ending):
            return []
        join = self.weights.get(self.JOIN, 0.0)
        table_ = [((0.0, None), (-math.inf, None))]
        for j in range(1, n + 1):
            (a, _), (b, _) = table_[j - 1]
            outside = max(((a, (j - 1, 0, None)), (b, (j - 1, 1, None))), key=lambda x: x[0])
            inside = (-math.inf, None)
            for i, kind, s in ending[j]:
                (p, _), (q, _) = table_[i]
                for value, state in ((p + s, 0), (q + s + join, 1)):
                    if value > inside[0]:
                        inside = (value, (i, state, kind))
            table_.append((outside, inside))
        out, j, state = [], n, int(table_[n][1][0] > table_[n][0][0])
        while j:
            i, before, kind = table_[j][state][1]
            if kind:
                out.append((kind, toks[i][0], toks[j - 1][1]))
            j, state = i, before
        return out[::-1]


def generated(seed=11, n=700):
    """Texts with their true spans: the kinds in several spellings, alone, next to one another, and numbers that are none of them."""
    rng = np.random.default_rng(seed)

    def pick(x):
        return x[int(rng.integers(len(x)))]

    def num(k):
        return "".join(str(int(x)) for x in rng.integers(0, 10, k))

    def word():
        return "".join(pick("abcdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9))))

    def card():
        d = pick("3456789012") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick([d, d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone():
        a, b, c = pick("23456789") + num(2), num(3), num(4)
        if rng.random() < 0.15:
            return f"{a} {b} {c}"  # a phone only after a cue; elsewhere a number like others
        return pick([f"+{pick(['1', '44', '49', '33'])} ({a}) {b}-{c}"] * 4 + [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{num(11).replace('0', '4')}"])

    def ip():
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def email():
        a, b, c = word(), word(), pick(["com", "org", "net", "de", "fr"])
        return pick([f"{a}.{num(2)}@{b}.example.{c}", f"{a}@{b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}(dot){c}", f"{a} (at) {b}.{c}"])

    def none():
        bad = num(16)
        bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
        return pick([bad, bad, num(2) + "." + num(1), f"{pick(['19', '20'])}{num(2)}-{num(2)}-{num(2)}", num(4), num(7), num(8), num(9), num(10), num(12), num(20), f"{num(3)},{num(3)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", "300.400.500.600", word() + num(3), f"{num(3)}-{num(2)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}", f"@{word()}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(5)} {num(5)}", "4" * 16 if not luhn("4" * 16) else bad])

    makers = {"card": card, "phone": phone, "ip": ip, "email": email}
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(3)), []
        for _ in range(int(rng.integers(1, 4))):
            kind = pick([*KINDS, *KINDS, "none", "none", "none"])
            value = makers[kind]() if kind in makers else none()
            bare = kind == "phone" and value.replace(" ", "").isdigit()
            if kind in CUES and (bare or rng.random() < 0.3):
                text += f" {pick(CUES[kind])}{pick(['', ':'])}"
            text += " "
            if kind in makers:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
            if rng.random() < 0.5:
                text += pick(["", ".", ","]) + " " + word()
        yield text, spans


def fit(examples, rounds=30, rate=0.3, ridge=1e-3) -> Field:
    """Conditional likelihood by AdaGrad, with exact expectations from forward and backward sums over segmentations."""
    data, names = [], {Field.JOIN: 0}
    for text, spans in examples:
        toks = tokens(text, 0, len(text))
        segs = list(segments(text, toks))
        rows = [[names.setdefault(f, len(names)) for f in s[3]] for s in segs]
        gold = {(k, a, b) for k, a, b in spans}
        true = [(s[2], toks[s[0]][0], toks[s[1] - 1][1]) in gold for s in segs]
        if segs:
            data.append((len(toks), segs, rows, true))
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-2)
    for _ in range(rounds):
        for n, segs, rows, true in data:
            score = [w[r].sum() for r in rows]
            ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for k, (i, j, _, _) in enumerate(segs):
                ending[j].append(k)
                starting[i].append(k)
            join = w[0]
            alpha = [(0.0, -math.inf)]
            for j in range(1, n + 1):
                ins = [x for k in ending[j] for x in (alpha[segs[k][0]][0] + score[k], alpha[segs[k][0]][1] + score[k] + join)]
                alpha.append((np.logaddexp(*alpha[j - 1]), np.logaddexp.reduce(ins) if ins else -math.inf))
            beta = [(0.0, 0.0)] * (n + 1)
            for i in range(n - 1, -1, -1):
                out = np.logaddexp(beta[i + 1][0], -math.inf)
                ins = [score[k] + beta[segs[k][1]][1] for k in starting[i]]
                total = np.logaddexp.reduce(ins) if ins else -math.inf
                beta[i] = (np.logaddexp(out, total), np.logaddexp(out, total + join))
            z = np.logaddexp(*alpha[n])
            grad: dict[int, float] = {}
            ends = {segs[k][1] for k, t in enumerate(true) if t}
            for k, (i, j, _, _) in enumerate(segs):
                free, joined = math.exp(min(0.0, alpha[i][0] + score[k] + beta[j][1] - z)), math.exp(min(0.0, alpha[i][1] + score[k] + join + beta[j][1] - z))
                delta = true[k] - free - joined
                for f in rows[k]:
                    grad[f] = grad.get(f, 0.0) + delta
                grad[0] = grad.get(0, 0.0) + (true[k] and i in ends) - joined
            at = np.fromiter(grad, np.int64)
            d = np.fromiter(grad.values(), float) - ridge * w[at]
            g2[at] += d * d
            w[at] += rate * d / np.sqrt(g2[at])
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6})


@lru_cache(1)
def trained() -> Field:
    return fit(generated())


def zones(text: str):
    """Stretches that may hold spans, near ones put together, and cut where they grow too long for one decoding."""
    at, end = None, 0
    for m in ZONE.finditer(text):
        if at is not None and (m.start() > end + 3 or end - at > 4000):
            yield at, end
            at = None
        at = m.start() if at is None else at
        end = m.end()
    if at is not None:
        yield at, end


def more_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that touch no base span."""
    starts = sorted((s, e) for _, s, e in base)
    taken: list[tuple[int, int]] = []
    for s, e in starts:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    begin, stop = [s for s, _ in taken], [e for _, e in taken]
    out = []
    for a, b in zones(text):
        part = text[a:b]
        if "@" not in part and "at" not in part.lower() and len(digits_of(part)) < 7:
            continue
        if any(s <= a and b <= e for s, e in taken[max(0, bisect_right(begin, a) - 1) : bisect_right(begin, a)]):
            continue
        for kind, s, e in field.best(text, tokens(text, a, b)):
            if bisect_left(begin, e) - bisect_right(stop, s) <= 0:
                out.append((KINDS.index(kind), s, e))
    return out


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both by kind, then start."""
    if "@" not in text and not re.search("[0-9]", text) and not re.search(r"[\[({] ?at ?[\])}]", text, re.IGNORECASE):
        return [], []
    base = sorted(base_spans(text))
    return base, sorted({*base, *more_spans(text, field, base)})


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end in code points) for every row of docs.

    Null and empty texts have none. Null ids and repeated rows are kept. Whole texts are read, in time linear in their length. No rows give
    no rows; other columns are ignored.
    """
    field, kind = trained(), docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [find(t or "", field) for t in batch.column(1).to_pylist()]
            cells = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[c]] for x in found] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[0], span), pa.array(cells[1], span)], ["doc_id", "base", "spans"])

    array = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base {array}, spans {array}")


def op3_pii(spark, sf_dir):
    found = detect(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
