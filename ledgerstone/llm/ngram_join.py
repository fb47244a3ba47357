"""N-gram Jaccard self-join by chosen paths.

Documents become sets of word shingles; equal sets are collapsed first. Every set is embedded as COORDS
min-hash values. A node of the recursion splits its sets on sampled coordinates, each drawn with
probability 1 / (threshold * COORDS): sets that share a sampled value go on together. A node with few sets, or
at the deepest level, is a leaf and is compared by brute force, in tiles of bounded size. Runs start
from different coordinates and repeat until pairs at the threshold are missed with less than the allowed
probability.

A pair is looked at in the first leaf it shares only, so that links can be counted without ever
listing all pairs. Pairs whose min-hash estimate is far below the threshold go; the rest is verified on the full
shingle sets. Each tile reports counts and a spanning forest of its links, from which classes grow.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, pieces, table

WORDS, THRESHOLD = 5, 0.8
COORDS, SMALL, TILE, DEPTH = 64, 2000, 512, 3
UNDER = 1e-5  # how often a pair at the threshold may have fewer equal coordinates than estimate_for() asks for
BLOOM = 1 << 23
WORD = re.compile(r"\w+")
RNG = np.random.default_rng(20240607)
FLIP, TIMES = (RNG.integers(1, 2**63, COORDS, dtype=np.uint64) for _ in range(2))
TIMES |= np.uint64(1)
ORDER = RNG.permutation(COORDS)


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes; remembers words up to a bound."""

    def __init__(self, words=WORDS, remember=200_000):
        self.words, self.remember, self.known = words, remember, {}

    def _hash(self, word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Lower-case runs of word characters, `words` at a time; a shorter text is one shingle; a text without words has none."""
        docs = [WORD.findall(t.lower()) for t in texts]
        if len(self.known) > self.remember:
            self.known = {}
        known = self.known
        for w in set(chain.from_iterable(docs)).difference(known):
            known[w] = self._hash(w)
        length = [len(d) for d in docs]
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.uint64, sum(length))
        out, at = [], 0
        for n in length:
            x = h[at : at + n]
            at += n
            m = max(1, n - self.words + 1) if n else 0
            total = np.zeros(m, np.uint64)
            for j in range(min(self.words, n)):
                total = total * np.uint64(0x9E3779B97F4A7C15) + x[j : j + m]
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(np.unique(total ^ (total >> np.uint64(29))))
        return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """COORDS min-hash values of 32 bits."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[i : i + 4096, None] ^ FLIP) * TIMES).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def mixed(*parts) -> np.ndarray:
    out = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(32))
    return out


def runs_for(missed: float) -> int:
    """Runs until a pair at the threshold is missed with probability `missed` at the most, were all its nodes split to the deepest level.

    With coordinates drawn as above such a pair has one common child in expectation, Poisson distributed, so that the chance to
    meet at level d is 1 - exp(-(chance at d - 1)).
    """
    meet = 1.0
    for _ in range(DEPTH):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(missed) / math.log(1 - meet))


def estimate_for(threshold: float) -> int:
    """Equal coordinates of COORDS that a pair must have: at the threshold fewer come up in UNDER of all cases."""
    below = 0.0
    for n in range(COORDS + 1):
        below += math.comb(COORDS, n) * threshold**n * (1 - threshold) ** (COORDS - n)
        if below > UNDER:
            return n
    return COORDS


def roots_for(threshold: float, missed: float) -> int:
    """Coordinates that the runs start from, 1 / threshold each. Fails where COORDS can't give so many."""
    wanted = math.ceil(runs_for(missed) / threshold)
    if not 0 < threshold <= 1 or wanted > COORDS:
        raise ValueError(f"a threshold of {threshold} with {missed} missed needs {wanted} coordinates; there are {COORDS}")
    return wanted


def blocks(texts, size=1_000_000):
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sign(docs: DataFrame) -> DataFrame:
    """docs: doc_id, k1, k2 (hashes of id and text), text. Adds set (its digest; null without words) and its sketch."""

    def run(batches):
        shingler = Shingler()
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for a, b in blocks(texts):
                found = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes()) if len(s) else (None, None) for s in shingler.sets(texts[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["doc_id", "k1", "k2", "set", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, set binary, sketch binary")


def values(column) -> np.ndarray:
    """Binary cells of equal length as rows of 32-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def roots(sets: DataFrame, threshold: float, missed: float) -> DataFrame:
    """(node, s) of the first level: runs draw their coordinates without replacement, 1 / threshold each on average."""
    picked = ORDER[: roots_for(threshold, missed)]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = values(batch.column(1))
            s = np.repeat(batch.column(0).to_numpy(), len(picked))
            node = mixed(picked[None, :], v[:, picked]).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(s)], ["node", "s"])

    return sets.select("s", "sketch").mapInArrow(run, "node long, s long")


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: node, s, sketch. The children (node, s), on coordinates drawn by the node."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            node, v = batch.column(0).to_numpy().astype(np.uint64), values(batch.column(2))
            draw = mixed(node[:, None], 77, np.arange(COORDS)[None, :]) >> np.uint64(11)
            i, j = np.nonzero(draw < np.uint64(2**53 / (threshold * COORDS)))
            child = mixed(node[i], j, v[i, j]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(batch.column(1).to_numpy()[i])], ["node", "s"])

    return rows.select("node", "s", "sketch").mapInArrow(run, "node long, s long")


def leaves(sets: DataFrame, threshold: float, missed: float) -> DataFrame:
    """(leaf, s, n): the sets of each leaf with two or more."""
    level, found = roots(sets, threshold, missed), None
    for depth in range(1, DEPTH + 1):
        # Repeats go by node and set, and counts are written first, so that the join by node, which may be hot, has no aggregate beside it that keeps Spark from splitting it.
        level = materialise(level if depth == 1 else level.dropDuplicates(["node", "s"]), f"paths-{depth}")
        busy = materialise(level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), f"busy-{depth}")
        together = materialise(level.join(busy, "node"), f"nodes-{depth}")
        drop(level)
        done = together if depth == DEPTH else together.filter(F.col("n") <= SMALL)
        found = done if found is None else found.unionByName(done)
        large = together.filter(F.col("n") > SMALL)
        if depth == DEPTH or large.isEmpty():
            return found.withColumnRenamed("node", "leaf")
        level = split(large.select("node", "s").join(sets.select("s", "sketch"), "s"), threshold)
    raise AssertionError


def one_batch(held) -> pa.RecordBatch:
    """Record batches as one. Arrow cuts columns of strings or bytes at 2 GiB, so that rows would be apart that belong together: that is an error, and nothing is dropped."""
    found = pa.Table.from_batches(held).combine_chunks().to_batches()
    if len(found) > 1:
        raise ValueError(f"{sum(map(len, found))} rows that belong together have over 2 GiB in a column")
    return found[0]


def grouped(batches, key_columns: int):
    """Record batches sorted by their first columns -> batches that end where a key ends."""
    waiting: list[pa.RecordBatch] = []

    def key(b, i):
        return tuple(b.column(c)[i].as_py() for c in range(key_columns))

    for batch in batches:
        if not len(batch):
            continue
        if waiting and key(waiting[-1], len(waiting[-1]) - 1) != key(batch, 0):
            yield one_batch(waiting)
            waiting = []
        last = key(batch, len(batch) - 1)
        cut = len(batch) - 1
        while cut > 0 and key(batch, cut - 1) == last:
            cut -= 1
        if cut:
            yield one_batch([*waiting, batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield one_batch(waiting)


def starts_of(*columns) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def tiled(rows: DataFrame) -> DataFrame:
    """rows: leaf, s, n and more. Deals each leaf into tiles; a row goes to every pair of tiles that its own takes part in: a, b, and side."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.hash("s", F.lit(5)), tiles)
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("a"), F.greatest(own, t).alias("b"), (own > t).cast("int").alias("side")))
    return rows.select("*", F.explode(F.when(tiles > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))))).alias("tile")).select(*rows.columns, "tile.*")


def candidate_pairs(side, v, lists, leaf, same, estimate: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that look similar and share no earlier leaf."""
    n = len(v)
    if n <= 48:
        i, j = np.triu_indices(n, 1) if same else np.nonzero((side[:, None] == 0) & (side[None, :] == 1))
        ok = (v[i] == v[j]).sum(1) >= estimate
        i, j = i[ok], j[ok]
    else:
        left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        equal = np.zeros((len(left), len(right)), np.uint8)
        for c in range(COORDS):
            equal += v[left, c][:, None] == v[right, c][None, :]
        i, j = np.nonzero(equal >= estimate)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    earlier = [x[: np.searchsorted(x, leaf)] for x in lists]
    if len(i) > 500:
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        member = np.zeros((n, len(names)), np.float32)
        member[np.repeat(np.arange(n), [len(x) for x in earlier]), at] = 1
        fresh = np.concatenate([np.einsum("ij,ij->i", member[i[k : k + 4096]], member[j[k : k + 4096]]) == 0 for k in range(0, len(i), 4096)]) if len(names) else np.ones(len(i), bool)
    else:
        fresh = np.array([not np.isin(earlier[a], earlier[b], assume_unique=True).any() for a, b in zip(i, j, strict=True)])
    return i[fresh], j[fresh]


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: leaf, a, b, side, s, sketch, leaves. (tile, s, partners): the sets that have candidates in a tile, with those of them on one side."""
    estimate = estimate_for(threshold)

    def run(batches):
        for batch in grouped(batches, 3):
            leaf, a, b, side, s = (batch.column(c).to_numpy() for c in range(5))
            v = values(batch.column(5))
            offsets, flat = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            starts = starts_of(leaf, a, b)
            out_tile, out_s, out_partners = [], [], []
            for x, y in zip(starts, [*starts[1:], len(leaf)], strict=True):
                if y - x < 2:
                    continue
                lists = [flat[offsets[k] : offsets[k + 1]] for k in range(x, y)]
                i, j = candidate_pairs(side[x:y], v[x:y], lists, leaf[x], a[x] == b[x], estimate)
                if not len(i):
                    continue
                here = s[x:y]
                tile = int(mixed(leaf[x : x + 1], a[x : x + 1], b[x : x + 1]).astype(np.int64)[0])
                partners: dict[int, list[int]] = {int(k): [] for k in np.unique(np.concatenate([i, j]))}
                for p, q in zip(i.tolist(), here[j].tolist(), strict=True):
                    partners[p].append(q)
                out_tile += [tile] * len(partners)
                out_s += here[list(partners)].tolist()
                out_partners += partners.values()
            if out_s:
                yield pa.RecordBatch.from_arrays([pa.array(out_tile, pa.int64()), pa.array(out_s, pa.int64()), pa.array(out_partners, pa.list_(pa.int64()))], ["tile", "s", "partners"])

    keyed = rows.select("leaf", "a", "b", "side", "s", "sketch", "leaves")
    return keyed.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b").mapInArrow(run, "tile long, s long, partners array<long>")


def common_sizes(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j)."""
    if len(i) <= 400:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    size = [len(x) for x in sets]
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(names) + 2048, 2048))
    for c, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = np.zeros((len(sets), 2048), np.float32)
        block[owner[order[x:y]], at[order[x:y]] - c * 2048] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: tile, s, partners, mult, shingles. (s, links, root): linked documents of a set in a tile, and its component there."""

    def run(batches):
        for batch in grouped(batches, 1):
            tile, s, mult = (batch.column(c).to_numpy() for c in (0, 1, 3))
            partners = batch.column(2)
            starts = starts_of(tile)
            out: list[np.ndarray] = []
            for x, y in zip(starts, [*starts[1:], len(tile)], strict=True):
                here = s[x:y]
                at = {k: i for i, k in enumerate(here.tolist())}
                lists = partners.slice(x, y - x).to_pylist()
                i = np.repeat(np.arange(y - x), [len(p) for p in lists])
                j = np.array([at[q] for p in lists for q in p], np.int64)
                if not len(i):
                    continue
                sets = [np.frombuffer(z, np.uint64) for z in batch.column(4).slice(x, y - x).to_pylist()]
                common = common_sizes(sets, i, j)
                size = np.array([len(z) for z in sets])
                ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                links = np.bincount(i, mult[x:y][j], y - x) + np.bincount(j, mult[x:y][i], y - x)
                label = np.arange(y - x)
                while True:
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    np.minimum.at(low, j, label[i])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                hit = np.flatnonzero(links)
                out.append(np.stack([here[hit], links[hit].astype(np.int64), here[label[hit]]]))
            if out:
                all_ = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(all_[c]) for c in range(3)], ["s", "links", "root"])

    keyed = rows.select("tile", "s", "partners", "mult", "shingles")
    return keyed.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "s long, links long, root long")


def needed_shingles(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(s, shingles, mult) of the sets in needed (s, k1, k2, mult). A Bloom filter of fixed size spares the other documents the work; the join is on 128 bits."""
    two = F.explode(F.array(*(x.bitwiseAND(BLOOM - 1).cast("int") for x in (F.col("k1"), F.shiftrightunsigned("k1", 40)))))
    bits = np.zeros(BLOOM, bool)
    bits[needed.select(two.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
    packed = np.packbits(bits)

    def run(batches):
        bits, shingler = np.unpackbits(packed).astype(bool), Shingler()
        for batch in pieces(batches):
            k = batch.column(0).to_numpy().astype(np.uint64)
            hit = np.flatnonzero(bits[k & np.uint64(BLOOM - 1)] & bits[(k >> np.uint64(40)) & np.uint64(BLOOM - 1)])
            texts = [t or "" for t in batch.column(2).take(pa.array(hit)).to_pylist()]
            for a, b in blocks(texts):
                found, at = [x.tobytes() for x in shingler.sets(texts[a:b])], pa.array(hit[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.binary())], ["k1", "k2", "shingles"])

    made = docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, shingles binary")
    return made.join(needed, ["k1", "k2"]).dropDuplicates(["s"]).select("s", "shingles", "mult")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. (s, label): label is the same within a component. Labels fall to neighbours' least ones and jump to their labels' labels."""
    both = materialise(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("s")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"s": "v", "label": "l"}), "v").groupBy(F.col("u").alias("s")).agg(F.min("l").alias("near"))
        lower = labels.join(near, "s").select("s", F.least("label", "near").alias("l"), F.col("label").alias("old"))
        lower = materialise(lower, "lower")
        jump = lower.select(F.col("s").alias("l"), F.col("l").alias("further"))
        new = materialise(lower.join(jump, "l", "left").select("s", F.least("l", F.coalesce("further", "l")).alias("label"), "old"), "labels")
        done = new.filter("label <> old").isEmpty()
        drop(labels)
        drop(lower)
        labels = new.select("s", "label")
        labels.ledgerstone_path = new.ledgerstone_path
        if done:
            return labels


def row_keys(id_col, text_col) -> list:
    """128 bits of a row's id and text, as two numbers."""
    return [F.xxhash64(F.lit(seed), id_col, F.xxhash64(F.lit(seed), text_col)).alias(f"k{seed}") for seed in (1, 2)]


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))


def join_classes(docs: DataFrame, threshold=THRESHOLD, missed=1e-3, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each row of docs: doc_id, k1, k2 (its key), class_id, links, first (it, or a repeat of it, stands for its class), wordless.

    links: how many other rows have a text of `threshold` similarity or more, copies included; a link is missed with probability `missed` at the
    most, and a threshold so low that COORDS can't give that is an error. class_id: the least id of the class, which
    links span. Null texts and texts without words link to nothing and are classes of their own; a text of under five words is one shingle.
    Texts are read whole. Null ids are kept, and aren't a class's id unless it has no other. Repeated rows are copies. No rows give no rows.
    Other columns, whatever their names, are ignored. Sets are told apart by 128 bits, and numbered, so that no two share a number.
    """
    roots_for(threshold, missed)
    own = keyed(docs, id_col, text_col)
    signed = materialise(sign(own), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2"))
    sets = signed.filter("set is not null").groupBy("set").agg(first.alias("first"), F.count("*").alias("mult"), F.first("sketch").alias("sketch"))
    sets = materialise(sets.select("set", F.monotonically_increasing_id().alias("s"), "first", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "mult", "sketch"), "sets")
    found = materialise(leaves(sets, threshold, missed), "leaves")
    lists = found.groupBy("s").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    rows = tiled(found.join(sets.select("s", "sketch").join(lists, "s"), "s"))
    similar = materialise(candidates(rows, threshold), "candidates")
    needed = materialise(similar.select("s").distinct().join(sets.select("s", "k1", "k2", "mult"), "s"), "needed")
    linked = materialise(verify(similar.join(needed_shingles(own, needed), "s"), threshold), "linked")
    labels = components(linked.select(F.col("s").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("s").agg(F.sum("links").alias("links"))
    of_set = sets.select("set", "s", "first", "mult").join(counts, "s", "left").join(labels, "s", "left")
    of_set = of_set.select("set", "first", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("label", "s").alias("label"))
    least = of_set.groupBy("label").agg(F.min("first").alias("least"))
    of_set = of_set.join(least, "label").select("set", "least", "links")
    for done in (found, similar, needed):
        drop(done)
    out = signed.select("doc_id", "k1", "k2", "set").join(of_set, "set", "left")
    alone = F.col("set").isNull()
    stands = alone | ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")))
    return out.select("doc_id", "k1", "k2", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), stands.alias("first"), alone.alias("wordless"))


def keep_one(docs: DataFrame, threshold=THRESHOLD, missed=1e-3) -> DataFrame:
    """docs with one row of each class: that of least id, one that has an id if any has. Columns, whatever their names, stay.

    Rows without words are classes of their own and all stay, repeats too; of repeats of any other row one stays, and if they differ in other columns
    the one with the least hash of all its columns, so that reruns agree. Repeats are summed up before they are shuffled, however many there are.
    """
    classes = materialise(join_classes(docs, threshold, missed), "classes")
    kept = classes.filter("first").groupBy("k1", "k2", "wordless").agg(F.count("*").alias("n"))
    cells = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_keys(docs["doc_id"], docs["text"]), *(F.xxhash64(F.lit(f"row {i}"), *cells).alias(f"h{i}") for i in (1, 2)))
    rows = rows.join(kept, ["k1", "k2"])
    repeats = rows.filter("n > 1 and not wordless").groupBy("k1", "k2").agg(F.min_by("row", F.struct("h1", "h2")).alias("row"))
    return rows.filter("n = 1 or wordless").select("row").unionByName(repeats.select("row")).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op4_ngram_join(spark, sf_dir):
    return join_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


# Brute force: all pairs of rows that share a shingle, and the closure of their links. For small tables.
ORACLE = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, i, i + {WORDS - 1}) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT r, hash(g) AS g FROM s),
n AS (SELECT r, count(*) AS n FROM h GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE c.c >= {THRESHOLD}::DOUBLE * (p.n + q.n - c.c) - 1e-9::DOUBLE),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
least AS (SELECT x AS r, min(o.doc_id) AS least FROM reach JOIN d o ON o.r = y GROUP BY x),
deg AS (SELECT x AS r, count(*) AS links FROM e GROUP BY x)
SELECT doc_id, coalesce(least(least, doc_id), doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links FROM d LEFT JOIN least USING (r) LEFT JOIN deg USING (r)"""
