"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other numbers or names in it
has the same template. Hashes of template windows of documents are joined with those of benchmark items. Windows of
an item that line up in a document count if the values in their slots are consistent: one value of the
item stands for one value of the document throughout. Capitals make a name a slot or not, and
an item may be nearly all slots: so each item also has literal windows, without regard to case, and either form finds it.

A Bloom filter of fixed size, built from the benchmark's windows, keeps windows that can't match out of
the shuffle; the join itself is exact on 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

# Spelt numbers and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a mph kph km/h m/s j kj kcal cal n pa kpa k c f °c °f percent % usd eur dollars dollar euros euro cents cent miles mile meters metres meter metre kilometers kilometres grams gram kilograms liters litres liter litre inches inch feet foot pounds pound".split())

WINDOW, LITERALS, SHORTEST = 6, 3, 3
BLOOM = 1 << 22
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
OUTER = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
SIGN = re.compile(r"[-+*/=^<>×÷·−]+")
ENDS = re.compile(r"[.!?:;][\"')\]»”]*$")
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
MARKS = np.array([0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47], np.uint64)


def look(token: str) -> tuple[int, int, bool, str] | None:
    """Hash of the lower-case literal, what the token may be, whether it ends a sentence, its value. None for tokens of marks only."""
    core = OUTER.sub("", token)
    if not core:
        return None
    low = core.lower()
    if NUMBER.fullmatch(core) or low in NUMBER_WORDS:
        kind = NUM
    elif core[0].isupper() and any(c.islower() for c in core[1:]):
        kind = NAME
    else:
        kind = UNIT if low in UNITS else LITERAL
    return int.from_bytes(hashlib.blake2b(low.encode("utf-8", "replace"), digest_size=8).digest(), "little"), kind, bool(ENDS.search(token)), low.replace(",", "") if kind == NUM else low


class Templates:
    """Turns texts into template windows; remembers tokens up to a bound."""

    def __init__(self, remember=400_000):
        self.remember = remember
        self.forget()

    def forget(self):
        self.ids: dict[str, int] = {}
        self.hash, self.kind, self.ends = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int8), np.zeros(1 << 12, bool)

    def add(self, tokens):
        need = len(self.ids) + len(tokens)
        while need > len(self.hash):
            self.hash, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind, self.ends))
        for t in tokens:
            i = self.ids[t] = len(self.ids)
            found = look(t)
            if found:
                self.hash[i], self.kind[i], self.ends[i], _ = found
            else:
                self.kind[i] = -1
                if SIGN.fullmatch(t):
                    self.hash[i] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")

    def read(self, texts: list[str]):
        """Tokens of all texts in a row, the text of each, its template hash, whether it is a slot, its literal hash, and the signs of arithmetic before it."""
        docs = [t.split() for t in texts]
        if len(self.ids) > self.remember:
            self.forget()
        if new := set(chain.from_iterable(docs)).difference(self.ids):
            self.add(new)
        length = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs)), np.int64, int(length.sum()))
        owner = np.repeat(np.arange(len(docs)), length)
        real = self.kind[ids] >= 0
        where, marks = np.flatnonzero(real), np.flatnonzero(~real & (self.hash[ids] != 0))
        signs, ids, owner = self.hash[ids[marks]], ids[real], owner[real]
        kind, ends = self.kind[ids].copy(), self.ends[ids]
        after = np.searchsorted(where, marks)  # the token that follows a sign; one of its neighbours has to be a number
        beside = np.zeros(len(ids) + 1, bool)
        beside[:-1] = kind == NUM
        beside[1:] |= kind == NUM
        before = np.zeros(len(ids) + 1, np.uint64)
        np.add.at(before, after[beside[after]], signs[beside[after]])
        first = np.ones(len(ids), bool)
        first[1:] = owner[1:] != owner[:-1]
        fresh = first.copy()
        fresh[1:] |= ends[:-1]
        kind[(kind == NAME) & fresh] = LITERAL
        after = np.zeros(len(ids), bool)
        after[1:] = (kind[:-1] == NUM) & ~first[1:]
        kind[(kind == UNIT) & ~after] = LITERAL
        h = np.where(kind == LITERAL, self.hash[ids], MARKS[kind])
        return docs, where, owner, h, kind != LITERAL, self.hash[ids], before[:-1]

    def windows(self, texts: list[str], forms=((WINDOW, False),), keep=None):
        """(text, place in it, window size, hash, slot values) of every window that keep() lets through. forms: sizes, and whether windows
        are literal: those have no slots, but hold the signs between their numbers; the others need enough literals.
        """
        docs, where, owner, template, slot, literal, before = self.read(texts)
        begin = np.searchsorted(owner, np.arange(len(texts)))
        flat = None
        for size, exact in forms:
            h = literal if exact else template
            n = len(h) - size + 1
            if n <= 0:
                continue
            total, literals = np.zeros(n, np.uint64), np.zeros(n, np.int8)
            for j in range(size):
                total = total * np.uint64(0x100000001B3) + h[j : j + n]
                if not exact:
                    literals += ~slot[j : j + n]
                elif j:
                    total += before[j : j + n]
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size + 64 * exact)
            total ^= total >> np.uint64(32)
            ok = owner[: n] == owner[size - 1 :]
            if not exact:
                ok &= literals >= min(LITERALS, size)
            at = np.flatnonzero(ok)
            if keep is not None:
                at = at[keep(total[at])]
            if len(at) and flat is None:
                flat = list(chain.from_iterable(docs))
            for a in at.tolist():
                values = [look(flat[where[i]])[3] for i in range(a, a + size) if slot[i] and not exact]
                yield int(owner[a]), a - int(begin[owner[a]]), size, int(total[a].astype(np.int64)), values


def blocks(texts: list[str], size=1_500_000):
    """Ranges of texts of about so many characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def item_windows(benchmark: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """item_id, n (its windows), size, exact, h, at, slots. An item shorter than a window is one window of its own length; under three words it
    has none. Template windows need enough literals; literal ones (exact) are there for every item. n counts those of the same form.
    """
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches):
        maker = Templates()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for i, t in zip(ids, texts, strict=True):
                m = len(maker.read([t])[3])
                for exact in (False, True) if m >= SHORTEST else ():
                    found = list(maker.windows([t], ((min(WINDOW, m), exact),)))
                    out += [(i, len(found), size, exact, h, at, values) for _, at, size, h, values in found]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "n", "size", "exact", "h", "at", "slots"])

    own = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).dropna().dropDuplicates()
    return materialise(own.mapInArrow(run, f"item_id {kind}, n int, size int, exact boolean, h long, at int, slots array<string>"), "bench-windows")


def bloom(windows: DataFrame) -> np.ndarray:
    """Bits at two places a hash; BLOOM bits, however many windows."""
    two = F.explode(F.array(*(x.bitwiseAND(BLOOM - 1).cast("int") for x in (F.col("h"), F.shiftrightunsigned("h", 40)))))
    bits = np.zeros(BLOOM, bool)
    bits[windows.select(two.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
    return np.packbits(bits)


def consistent(pairs: list[tuple[int, list[str], list[str]]], least=0.75) -> list[int]:
    """Window places of one alignment whose slots agree with the alignment's main reading: each item value stands for one document value.

    If fewer than `least` of all slots agree, none count.
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    for _, item, doc in pairs:
        for a, b in zip(item, doc, strict=True):
            votes[a][b] += 1
    main = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
    total = sum(sum(c.values()) for c in votes.values())
    if total and sum(votes[a][b] for a, b in main.items()) < least * total:
        return []
    return sorted({at for at, item, doc in pairs if all(main[a] == b for a, b in zip(item, doc, strict=True))})


def text_key(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def matches(docs: DataFrame, benchmark: DataFrame, least_share=0.5, text_col="text") -> DataFrame:
    """k1, k2 (text_key of a text), item_id, matched, windows, share: the texts that hold least_share of an item's windows of one form at least; the form of larger share."""
    items = item_windows(benchmark)
    bits = bloom(items)
    forms = tuple(sorted(map(tuple, items.select("size", "exact").distinct().collect())))

    def keep(h):
        def bit(x):
            return (bits[x >> np.uint64(3)] >> (np.uint8(7) - (x & np.uint64(7)).astype(np.uint8))) & 1 == 1

        mask = np.uint64(BLOOM - 1)
        found = np.flatnonzero(bit(h & mask))
        out = np.zeros(len(h), bool)
        out[found] = bit((h[found] >> np.uint64(40)) & mask)
        return out

    def run(batches):
        maker = Templates()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                found = list(maker.windows(texts[a:b], forms, keep))
                if not found:
                    continue
                row = pa.array([a + x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array([x[3] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.list_(pa.string()))], ["k1", "k2", "h", "place", "found"]
                )

    texts = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("text")).dropna(subset=["text"])
    hits = texts.mapInArrow(run, "k1 long, k2 long, h long, place int, found array<string>")
    lined = hits.join(items, "h").groupBy("k1", "k2", "item_id", "exact", (F.col("place") - F.col("at")).alias("offset"))
    lined = lined.agg(F.first("n").alias("n"), F.collect_set(F.struct("at", "slots", "found")).alias("pairs"))

    def check(batches):
        for batch in batches:
            good = [consistent([(p["at"], p["slots"], p["found"]) for p in pairs]) for pairs in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3, 5)), pa.array(good, pa.list_(pa.int32()))], ["k1", "k2", "item_id", "exact", "n", "good"])

    kind = items.schema["item_id"].dataType.simpleString()
    good = lined.mapInArrow(check, f"k1 long, k2 long, item_id {kind}, exact boolean, n int, good array<int>")
    whole = good.groupBy("k1", "k2", "item_id", "exact").agg(F.size(F.array_distinct(F.flatten(F.collect_list("good")))).alias("matched"), F.first("n").alias("windows"))
    whole = whole.withColumn("share", F.col("matched") / F.col("windows")).filter(F.col("share") >= least_share)
    best = whole.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("share", "matched", "windows")).alias("best"))
    return best.select("k1", "k2", "item_id", "best.matched", "best.windows", "best.share")


def leaks(docs: DataFrame, benchmark: DataFrame, least_share=0.5, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, item_id, matched, windows, share: a row for each row of docs and each item that it holds.

    Null and empty texts hold nothing; null and empty items, and those under three words, are in no document; every other item is
    searched for. Repeated rows are reported each, repeated items once. Without items or rows the result is empty. Only id and text columns are read.
    """
    found = matches(docs, benchmark, least_share, text_col)
    keys = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)))
    return keys.join(found, ["k1", "k2"]).select("doc_id", "item_id", "matched", "windows", "share")


def clean(docs: DataFrame, benchmark: DataFrame, least_share=0.5, text_col="text") -> DataFrame:
    """docs without the rows whose text holds an item; columns, whatever their names, stay.

    Null and empty texts hold nothing and stay; repeated rows fare alike; a share of just least_share is a hold. Without items all rows stay; no rows give none.
    """
    found = matches(docs, benchmark, least_share, text_col).select("k1", "k2").distinct()
    k1, k2 = text_key(docs[text_col])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1, k2)
    return rows.join(found, ["k1", "k2"], "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op9_decontam(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
