"""Strata: TF-IDF weights inside a row, truncated SVD, mini-batch k-means, distances to centroids."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import SLICE, sliced
from ..sources.work import drop, materialise, settle

HELD = 200_000  # words or pairs that a task counts before it hands them on
MOST, MOST_BYTES = 1 << 19, 64 << 20  # words, and bytes of them, that a dictionary may have


def mark_ranges() -> str:
    """Combining marks as ranges of a character class: they are part of words."""
    marks = [c for c in range(0x300, 0x1E950) if unicodedata.category(chr(c))[0] == "M"]
    edges = [i for i, c in enumerate(marks) if not i or c != marks[i - 1] + 1]
    return "".join(f"\\U{marks[i]:08x}-\\U{marks[j - 1]:08x}" for i, j in zip(edges, [*edges[1:], len(marks)]))


WORDS = rf"[\w{mark_ranges()}]{{2,}}"


def words_of(text: str, find, stop) -> list[str]:
    """Words of two or more word characters that aren't stop words."""
    found = find(text.lower())
    return [w for w in found if w not in stop] if stop else found


# --- terms -----------------------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, stop) -> DataFrame:
    """term, df, total of single words. docs: text. What tasks hand on is counted already."""

    def count(batches):
        find, total, df = re.compile(WORDS).findall, Counter(), Counter()

        def rows():
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array([df[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "df", "total"])
            total.clear()
            df.clear()
            return out

        for part in sliced(batches):
            for text in part["text"].to_pylist():
                words = words_of(text or "", find, stop)
                total.update(words)
                df.update(set(words))
            if len(total) > HELD:
                yield rows()
        if total:
            yield rows()

    return docs.select("text").mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_counts(docs: DataFrame, stop) -> DataFrame:
    """term, df, total of words and of pairs of neighbours among them, whatever their number."""

    def count(batches):
        find = re.compile(WORDS).findall
        for part in sliced(batches):
            total, df = Counter(), Counter()
            for text in part["text"].to_pylist():
                words = words_of(text or "", find, stop)
                terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
                total.update(terms)
                df.update(set(terms))
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([df[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "df", "total"])

    return docs.select("text").mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def numbered(texts, find, stop, number) -> list[np.ndarray]:
    """For each text the numbers of its words in order, -1 for words without one."""
    return [np.array([number.get(w, -1) for w in words_of(t or "", find, stop)], np.int64) for t in texts]


def pair_counts(docs: DataFrame, stop, words) -> DataFrame:
    """code, df, total of pairs of neighbours that are both in a broadcast list of words; a code is the first one's number times their number plus the second's."""

    def count(batches):
        find, number, k = re.compile(WORDS).findall, {w: i for i, w in enumerate(words.value)}, len(words.value)
        held, n = [], 0

        def merged():
            code, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, *(np.bincount(place, np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2))

        for part in sliced(batches):
            ids = numbered(part["text"].to_pylist(), find, stop, number)
            codes = [np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] * k + x[1:], -1) for x in ids]
            code, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            each, times = np.unique((code * SLICE + owner)[code >= 0], return_counts=True)
            code, first = np.unique(each // SLICE, return_index=True)
            if len(code):
                held.append((code, np.diff([*first, len(each)]), np.add.reduceat(times, first)))
                n += len(code)
            if n > 4 * HELD:
                held = [merged()]
                if (n := len(held[0][0])) > 2 * HELD:
                    yield pa.record_batch(list(map(pa.array, held[0])), names=["code", "df", "total"])
                    held, n = [], 0
        if held:
            yield pa.record_batch(list(map(pa.array, merged())), names=["code", "df", "total"])

    return docs.select("text").mapInArrow(count, "code long, df long, total long").groupBy("code").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(docs: DataFrame, features=40_000, min_df=2, max_df=0.92, stop=(), most=MOST) -> tuple[list[tuple[str, int]], int]:
    """(term, df) of the `features` commonest terms, ties by term, and the number of texts. docs: text.

    A pair is no commoner than either of its words. So once single words are counted, the count of the last of the `features` commonest ones bounds what a word of
    a wanted pair has, and pairs are counted by number among those words only. If they are too many for a dictionary (all counts equal, say), terms are counted as they are.
    """
    spark, stop = docs.sparkSession, frozenset(stop)
    n = docs.count()
    fits = (F.col("df") >= min_df) & (F.col("df") <= max_df * n)
    words = materialise(word_counts(docs, stop), "words", "zstd")
    first = words.filter(fits).select("total").orderBy(F.desc("total")).limit(features).agg(F.min("total"), F.count("*")).first()
    least = first[0] if first[1] == features else min_df
    used = words.filter((F.col("total") >= least) & (F.col("df") >= min_df))
    size = used.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] <= most and size[1] <= MOST_BYTES:
        held = sorted(r["term"] for r in used.select("term").collect())  # within both bounds
        names = spark.createDataFrame(pa.table({"i": pa.array(range(len(held)), pa.int64()), "w": pa.array(held, pa.string())}))
        k = max(1, len(held))
        pairs = pair_counts(docs, stop, spark.sparkContext.broadcast(held)).filter(fits & (F.col("total") >= least))
        pairs = pairs.withColumn("a", F.expr(f"code div {k}")).withColumn("b", F.col("code") % k)
        pairs = pairs.join(names.select(F.col("i").alias("a"), F.col("w").alias("wa")), "a").join(names.select(F.col("i").alias("b"), F.col("w").alias("wb")), "b")
        counts = words.filter(fits & (F.col("total") >= least)).unionByName(pairs.select(F.concat_ws(" ", "wa", "wb").alias("term"), "df", "total"))
    else:
        counts = term_counts(docs, stop).filter(fits)
    known = counts.orderBy(F.desc("total"), "term").limit(features).collect()  # `features` rows
    drop(words)
    return [(r["term"], r["df"]) for r in known], n


@dataclass
class Dictionary:
    """Terms by place, looked up inside a row: numbers of the words in them, places of single words by number, sorted codes of pairs with their places."""

    terms: list[str]
    idf: np.ndarray
    number: dict[str, int]
    single: np.ndarray
    codes: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, known, n) -> Dictionary:
        terms = [t for t, _ in known]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for t in terms for w in t.split(" ")))}
        single = np.full(len(number), -1, np.int64)
        pairs = []
        for place, t in enumerate(terms):
            a, _, b = t.partition(" ")
            if b:
                pairs.append((number[a] * len(number) + number[b], place))
            else:
                single[number[a]] = place
        codes, places = (np.array(x, np.int64) for x in (zip(*sorted(pairs)) if pairs else ((), ())))
        return cls(terms, 1 + np.log((1 + n) / (1 + np.array([df for _, df in known], float))), number, single, codes, places)

    def counted(self, ids: np.ndarray):
        """Places and counts of the terms in a text. ids: its words' numbers in order."""
        singles = self.single[ids[ids >= 0]]
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        code = (ids[:-1] * len(self.number) + ids[1:])[both]
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        pairs = self.places[at[self.codes[at] == code]] if len(self.codes) else code[:0]
        return np.unique(np.concatenate((singles[singles >= 0], pairs)), return_counts=True)


def weigh(docs: DataFrame, text: str, features=40_000, min_df=2, max_df=0.92, stop=(), id_col="doc_id", most=MOST) -> tuple[DataFrame, list[str]]:
    """Rows (id, places, weights) of the texts that hold a known term, materialised, and the terms by place: (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), rows of length one.

    Only counts of words and of pairs by number are shuffled; weights are worked out inside a row from a dictionary of at most `features` terms. Null texts are empty.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    known, n = vocabulary(own, features, min_df, max_df, stop, most)
    shared, stop = own.sparkSession.sparkContext.broadcast(Dictionary.of(known, n)), frozenset(stop)

    def weights(batches):
        find, held = re.compile(WORDS).findall, shared.value
        for part in sliced(batches):
            kept, places, values = [], [], []
            for i, ids in enumerate(numbered(part["text"].to_pylist(), find, stop, held.number)):
                at, times = held.counted(ids)
                if len(at):
                    raw = (1 + np.log(times)) * held.idf[at]
                    kept.append(i)
                    places.append(at)
                    values.append(raw / np.sqrt((raw * raw).sum()))
            yield pa.record_batch([part["id"].take(pa.array(kept, pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["id", "places", "weights"])

    rows = own.mapInArrow(weights, f"id {own.schema['id'].dataType.simpleString()}, places array<int>, weights array<double>")
    return materialise(rows.withColumnRenamed("id", id_col), "weights", "zstd"), [t for t, _ in known]


def tfidf(docs: DataFrame, text: str, features=40_000, min_df=2, max_df=0.92, stop=(), id_col="doc_id") -> DataFrame:
    """id, term, weight: what weigh() has, a row a weight."""
    rows, terms = weigh(docs, text, features, min_df, max_df, stop, id_col)
    names = rows.sparkSession.sparkContext.broadcast(terms)

    def spread(batches):
        spelt = pa.array(names.value, pa.string())
        for part in sliced(batches):
            many = np.diff(part["places"].offsets.to_numpy())
            owner = np.repeat(np.arange(len(part)), many)
            yield pa.record_batch([part[id_col].take(pa.array(owner)), spelt.take(part["places"].flatten()), part["weights"].flatten()], names=[id_col, "term", "weight"])

    return rows.mapInArrow(spread, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, term string, weight double")


# --- truncated SVD ---------------------------------------------------------------------------------------------------------------------

BLOCK, EXTRA = 512, 10  # rows of a matrix that travel together; columns beyond those asked for


def rows_of(part):
    """(places, weights) of each row of a batch."""
    at, w = part["places"], part["weights"]
    places, values, ends = at.flatten().to_numpy(), w.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(at.offsets.to_numpy())).tolist()
    begin = 0
    for end in ends:
        yield places[begin:end], values[begin:end]
        begin = end


def few_tasks(rows: DataFrame) -> DataFrame:
    """As many tasks as there are cores, or fewer if few rows are there: each holds a matrix of terms by columns, and hands on one."""
    return rows.coalesce(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // BLOCK)))


def through(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, A's rows being rows. Tasks hand on sums of blocks of terms, which are added up by block; the result, terms by columns, is the driver's."""
    shared, (m, width) = rows.sparkSession.sparkContext.broadcast(basis.astype(np.float32)), basis.shape

    def multiply(batches):
        own, total = shared.value, np.zeros((m, width), np.float32)
        for part in sliced(batches, 1000):
            for at, w in rows_of(part):
                w = w.astype(np.float32)
                total[at] += np.outer(w, w @ own[at])
        for i in range(0, m, BLOCK):
            yield pa.record_batch({"block": pa.array([i // BLOCK], pa.int32()), "cells": pa.array([total[i : i + BLOCK].tobytes()], pa.binary())})

    def add(batches):
        held = {}
        for part in batches:
            for block, cells in zip(part["block"].to_pylist(), part["cells"]):
                x = np.frombuffer(cells.as_buffer(), np.float32).astype(np.float64)
                held[block] = held[block] + x if block in held else x
        for block, x in held.items():
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "cells": pa.array([x.tobytes()], pa.binary())})

    kind = "block int, cells binary"
    blocks = -(-m // BLOCK)
    summed = few_tasks(rows).mapInArrow(multiply, kind).repartition(blocks, "block").mapInArrow(add, kind).toArrow().sort_by("block")  # terms by columns
    shared.destroy()
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in summed["cells"]]).reshape(m, width)


def triangle(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of A times the basis, by blocks: tasks decompose what they have, and the triangles are decomposed in turn, 32 at a time, until few are left."""
    shared, width = rows.sparkSession.sparkContext.broadcast(basis), basis.shape[1]

    def decompose(chunks):
        r = np.zeros((0, width))
        for x in chunks:
            r = np.linalg.qr(np.vstack((r, x)), "r")
        return pa.record_batch({"r": pa.array([r.tobytes()], pa.binary())})

    def leaves(batches):
        yield decompose(np.array([w @ shared.value[at] for at, w in rows_of(part)]).reshape(-1, width) for part in sliced(batches, 1000))

    def joints(batches):
        yield decompose(np.frombuffer(x.as_buffer()).reshape(-1, width) for part in batches for x in part["r"])

    parts = few_tasks(rows).mapInArrow(leaves, "r binary")
    many = rows.sparkSession.sparkContext.defaultParallelism
    while many > 64:
        many = -(-many // 32)
        parts = parts.repartition(many).mapInArrow(joints, "r binary")
    found = [np.frombuffer(x.as_buffer()).reshape(-1, width) for x in parts.toArrow()["r"]]
    return np.linalg.qr(np.vstack(found), "r")


def truncated_svd(rows: DataFrame, terms: int, dims: int, seed=3407, rounds=4) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the rows and their right vectors, terms by dims, on the driver: at most `features` times `dims` numbers. Randomised range finder with `rounds` power iterations, then TSQR.

    Values that hardly fall from one to the next come out a few hundredths low. The signs are such that each vector's largest entry is positive. Reruns agree up to the order of sums.
    """
    width = min(terms, dims + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(through(rows, basis))[0]
        settle(rows.sparkSession)  # a matrix of each task was shuffled
    _, s, w = np.linalg.svd(triangle(rows, basis))
    vectors = basis @ w.T[:, :dims]
    return s[:dims], vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])


def reduced(rows: DataFrame, terms: int, dims=160, seed=3407, id_col="doc_id", rounds=4) -> DataFrame:
    """id, features: the rows on their first singular vectors, min(dims, rows - 1, terms - 1) of them, made of length one; materialised. rows: what weigh() gives."""
    dims = max(1, min(dims, rows.count() - 1, terms - 1))
    vectors = truncated_svd(rows, terms, dims, seed, rounds)[1] if terms else np.zeros((0, dims))
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def turn(batches):
        for part in sliced(batches, 1000):
            x = np.array([w @ shared.value[at] for at, w in rows_of(part)]).reshape(-1, dims)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([part[id_col], pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=[id_col, "features"])

    return materialise(rows.mapInArrow(turn, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, features array<float>"), "vectors")


# --- k-means ---------------------------------------------------------------------------------------------------------------------------


def matrix(cells) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1) if len(cells) else np.zeros((0, 0))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def spread_start(x: np.ndarray, k: int, rng, of=4) -> np.ndarray:
    """Centres drawn one after another, each the best of a few drawn by their distance from those before; fewer than k if there are fewer distinct rows."""
    centres = [x[rng.integers(len(x))]]
    near = squares(x, centres[0][None])[:, 0]
    while len(centres) < k and near.max() > 1e-12:
        drawn = rng.choice(len(x), of, p=near / near.sum())
        after = np.minimum(near[:, None], squares(x, x[drawn]))
        best = after.sum(0).argmin()
        centres.append(x[drawn[best]])
        near = after[:, best]
    return np.array(centres)


def mini_batches(x: np.ndarray, k: int, rounds: int, batch: int, seed: int) -> np.ndarray:
    """Centres of one start: each round moves centres by a batch's means, weighted by how many rows they have had. Only a batch at a time is in double precision."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    centres = spread_start(x[order[: max(10 * k, 8 * batch)]].astype(np.float64), k, rng)
    had = np.zeros(len(centres))
    for i in range(rounds):
        part = x[np.take(order, range(i * batch, (i + 1) * batch), mode="wrap")].astype(np.float64)
        label = squares(part, centres).argmin(1)
        count = np.bincount(label, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, label, part)
        had += count
        some = count > 0
        centres[some] += (total[some] - count[some, None] * centres[some]) / had[some, None]
    return centres


def fitted(vectors: DataFrame, k: int, tries: int, rounds: int, batch: int, seed: int, id_col: str, polish: int) -> np.ndarray:
    """The best start's centres.

    Batches are drawn by a hash of the id: as many rows as all batches of a start have, rounds times batch, are what the starts see, each in an order of its own and in a task of its own.
    All starts are then judged over all rows in one scan, and the best one's centres are moved to their rows' means over all rows `polish` times.
    """
    spark, n = vectors.sparkSession, vectors.count()
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    share = min(1.0, rounds * batch / max(1, n))
    sample = vectors.filter(F.pmod(drawn, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select(drawn.alias("h"), "features").toArrow().sort_by("h")
    shared = spark.sparkContext.broadcast(matrix(sample["features"].combine_chunks()).astype(np.float32))

    def start(batches):
        for part in batches:
            for i in part["id"].to_pylist():
                yield pa.record_batch({"i": pa.array([i]), "c": pa.array([mini_batches(shared.value, k, rounds, batch, seed + i).tobytes()], pa.binary())})

    dims = shared.value.shape[1]
    begun = spark.range(0, tries, 1, tries).mapInArrow(start, "i long, c binary").toArrow().sort_by("i")  # tries times k centres
    starts = [np.frombuffer(c.as_buffer()).reshape(-1, dims) for c in begun["c"]]
    every = spark.sparkContext.broadcast(starts)

    def cost(batches):
        total = np.zeros(tries)
        for part in sliced(batches, 2000):
            x = matrix(part["features"])
            total += [squares(x, c).min(1).sum() for c in every.value] if len(x) else 0
        yield pa.record_batch({"i": pa.array(range(tries), pa.int64()), "cost": pa.array(total)})

    costs = vectors.select("features").mapInArrow(cost, "i long, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).collect()
    centres = starts[min(costs, key=lambda r: (r["cost"], r["i"]))["i"]].copy()
    for _ in range(polish):
        moved = spark.sparkContext.broadcast(centres)

        def means(batches, moved=moved):
            total, had = np.zeros_like(moved.value), np.zeros(len(moved.value))
            for part in sliced(batches, 2000):
                x = matrix(part["features"])
                if len(x):
                    label = squares(x, moved.value).argmin(1)
                    np.add.at(total, label, x)
                    had += np.bincount(label, minlength=len(had))
            k, d = total.shape
            yield pa.record_batch({"c": pa.array(np.repeat(np.arange(k), d)), "at": pa.array(np.tile(np.arange(d), k)), "v": pa.array(total.ravel()), "n": pa.array(np.repeat(had, d))})

        cells = vectors.select("features").mapInArrow(means, "c long, at long, v double, n double").groupBy("c", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()  # k times dims rows
        c, at, v, had = (cells[x].to_numpy() for x in ("c", "at", "v", "n"))
        some = had > 0
        centres = centres.copy()
        centres[c[some], at[some]] = v[some] / had[some]
    return centres


def cluster(vectors: DataFrame, k: int, tries=20, rounds=300, batch=256, seed=3407, id_col="doc_id", polish=3) -> DataFrame:
    """id, cluster_id, distance to the own centroid; of several tries the one of least cost over all rows. Labels differ between libraries: only their invariants can be relied on.

    vectors: id, features (array<float>), materialised. No more clusters than there are distinct vectors.
    """
    kind = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, cluster_id int, distance double"
    if vectors.isEmpty():
        return vectors.selectExpr(f"`{id_col}`", "0 AS cluster_id", "0D AS distance")
    shared = vectors.sparkSession.sparkContext.broadcast(fitted(vectors, k, tries, rounds, batch, seed, id_col, polish))

    def assign(batches):
        for part in sliced(batches, 2000):
            far = squares(matrix(part["features"]), shared.value) if len(part) else np.zeros((0, 1))
            yield pa.record_batch([part[id_col], pa.array(far.argmin(1).astype(np.int32)), pa.array(np.sqrt(far.min(1)))], names=[id_col, "cluster_id", "distance"])

    return vectors.mapInArrow(assign, kind)


def strata(docs: DataFrame, text: str, k: int, tries=20, rounds=300, batch=256, dims=160, seed=3407, id_col="doc_id", **options) -> DataFrame:
    """id, cluster_id, distance of the texts that hold a known term. options: what weigh() takes."""
    rows, terms = weigh(docs, text, id_col=id_col, **options)
    vectors = reduced(rows, len(terms), dims, seed, id_col)
    drop(rows)
    labels = materialise(cluster(vectors, k, tries, rounds, batch, seed, id_col), "labels")
    drop(vectors)
    return labels


def euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def centroid_distances(rows: DataFrame, vector: str, label: str, id_col: str) -> DataFrame:
    """id, label, distance of each vector to the mean of its label."""
    parts = rows.select(label, F.posexplode(vector).alias("at", "v")).groupBy(label, "at").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    centres = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("centre"))
    return rows.join(centres, label).select(id_col, label, euclid(F.transform(vector, lambda x: x.cast("double")), F.col("centre")).alias("distance"))


def largest_share(labels: DataFrame) -> DataFrame:
    """One row: the share of rows in the largest cluster."""
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("largest_share"))


def rank_in_cluster(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "doc_id")))
