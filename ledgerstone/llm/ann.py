"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search over it answers queries.

Equal vectors are one node. Nodes are numbered in the order of a random projection tree, so that neighbours tend to have near numbers. The
first graph comes from brute force inside blocks of bounded size along that order and along a second tree's. Each round joins every node's
neighbours, forward and reverse, with their vectors, compares them with one another, and keeps what improves a list, until few lists change.
Work is dealt in blocks of consecutive nodes, one partition a block; a block asks for each vector once.

For the largest inner product, vectors get one more component that makes all norms equal, so that near means
near for the graph too; queries have zero there. What is nearest to a query by inner product may be far from it in the graph, among vectors of
larger norm: a search begins at the query's own node and at the best for it of the vectors of largest norm. Results are scored on the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, table
from .ngram_join import grouped, one_batch, starts_of

NEIGHBOURS, BLOCK, DEALS, ROUNDS, ENOUGH = 64, 1024, 2, 12, 0.02
OFFER = 10  # of a neighbourhood's nodes, how many are offered to each of them: the nearest
WORK = 8192  # nodes that a task works on, with the vectors of all their neighbours
SAMPLE, SURE = 16_384, 10  # vectors that the trees' cuts are learned from, and levels that have a cut for each cell
BEAM, EXPAND, SPARE = 64, 24, 2
ENTRIES, GATES = 1024, 8  # vectors of the largest norms that every query is compared with, and how many of them its search begins at
ROW_BITS = 33  # of a node's number; the bits above them say in which range of nodes it is


def matrix(column, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def lists(column, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy().astype(kind, copy=False)


def list_array(values, sizes, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def dense(ids: np.ndarray) -> np.ndarray:
    """Numbers of nodes, or any small ones, without the gap between a range and the next: in the same order, and under 2^31 as long as nodes in even ranges are."""
    row = ids & ((1 << ROW_BITS) - 1)
    return ((ids >> ROW_BITS) * (int(row.max(initial=0)) + 1) + row).astype(np.uint64)


def falling(sims: np.ndarray) -> np.ndarray:
    """Numbers that sort as the floats do from the largest."""
    bits = (sims + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, bits, ~(bits | np.uint32(1 << 31))).astype(np.uint64)


def top(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, flags: np.ndarray, k: int):
    """The k largest of each owner, of repeats the one with the least flag: owner, ids, sims, flags by owner and falling sim, ties by id. Flags are from -1 to 2."""
    own, other = dense(owner.astype(np.int64, copy=False)), dense(ids.astype(np.int64, copy=False))
    if max(int(own.max(initial=0)), int(other.max(initial=0))) >> 31:
        order = np.lexsort((flags, ids, owner))
    else:  # one key sorts many times as fast as three
        order = np.argsort(own << np.uint64(33) | other << np.uint64(2) | (flags + 1).astype(np.uint64))
    o, i, s, f = owner[order], ids[order], sims[order], flags[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (i[1:] != i[:-1])
    o, i, s, f = o[first], i[first], s[first], f[first]
    place = own[order][first]
    if int(own.max(initial=0)) >> 32:
        order = np.lexsort((i, -s, o))
    else:
        key = place << np.uint64(32) | falling(s)
        order = np.argsort(key)
        there = key[order]
        if (there[1:] == there[:-1]).any():
            order = np.lexsort((i, key))
    o, i, s, f = o[order], i[order], s[order], f[order]
    starts = starts_of(o) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(starts, np.diff([*starts, len(o)]))
    keep = rank < k
    return o[keep], i[keep], s[keep], f[keep]


def by_owner(o, i, s, f):
    starts = starts_of(o) if len(o) else np.zeros(0, np.int64)
    sizes = np.diff([*starts, len(o)])
    return pa.RecordBatch.from_arrays([pa.array(o[starts], pa.int64()), list_array(i, sizes, pa.int64()), list_array(s, sizes, pa.float32()), list_array(f, sizes, pa.int8())], ["id", "near", "sims", "flags"])


def flat(batch, first: int):
    """owner, ids, sims, flags of the lists in columns first (id) to first + 3."""
    offsets, near = lists(batch.column(first + 1))
    _, sims = lists(batch.column(first + 2), np.float32)
    _, flags = lists(batch.column(first + 3), np.int8)
    a, b = offsets[0], offsets[-1]
    return np.repeat(batch.column(first).to_numpy(), np.diff(offsets)), near[a:b], sims[a:b], flags[a:b]


GRAPH = "id long, near array<long>, sims array<float>, flags array<tinyint>"  # a flag is 0 if the place is new, or else 1
PACK = "block int, owner array<long>, near array<long>, sims array<float>, flags array<tinyint>"  # places of many nodes of a block in one row


def packs(o, i, s, f, blocks: int):
    """A row for each block that places (owner, near, sim, flag) are for."""
    block = (o >> ROW_BITS) % blocks
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = starts_of(block) if len(block) else np.zeros(0, np.int64)
    sizes = np.diff([*starts, len(block)])
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), *(list_array(a[order], sizes, t) for a, t in ((o, pa.int64()), (i, pa.int64()), (s, pa.float32()), (f, pa.int8())))], ["block", "owner", "near", "sims", "flags"])


def unpacked(batch, first: int):
    """owner, near, sims, flags of all rows, in columns first to first + 3."""
    out = []
    for c, kind in zip(range(first, first + 4), (np.int64, np.int64, np.float32, np.int8), strict=True):
        offsets, values = lists(batch.column(c), kind)
        out.append(values[offsets[0] : offsets[-1]])
    return out


def packed(graph: DataFrame, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                yield packs(*flat(batch, 0), blocks)

    return graph.mapInArrow(run, PACK)


def whole(batches):
    """All batches of a partition as one, if there are rows."""
    held = [b for b in batches if len(b)]
    return [one_batch(held)] if held else []


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def work_blocks(df: DataFrame, n: int) -> int:
    """Blocks of at most WORK nodes, and one for each core unless they would be tiny."""
    return max(1, min(cores(df), math.ceil(n / 512)), math.ceil(n / WORK))


def by_block(rows: DataFrame, blocks: int, column="block") -> DataFrame:
    """A partition of its own for each block: no block waits for another, and nothing has to be sorted."""
    return rows.repartitionById(blocks, column)


def grow_tree(sample: np.ndarray, n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of a random projection tree with cells of about half a block: a direction, and a cut for each cell above (one cut for all beyond SURE levels)."""
    rng, code, tree = np.random.default_rng(seed), np.zeros(len(sample), np.int64), []
    for level in range(max(0, math.ceil(math.log2(max(1, n) / BLOCK * 2)))):
        plane = rng.standard_normal(sample.shape[1]).astype(np.float32)
        at = sample @ plane
        cuts = np.full(1 << level if level <= SURE else 1, np.median(at), np.float32)
        if level <= SURE:
            for c in np.unique(code):
                cuts[c] = np.median(at[code == c])
            code = 2 * code + (at > cuts[code])
        tree.append((plane, cuts))
    return tree


def cells(x: np.ndarray, tree) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for plane, cuts in tree:
        code = 2 * code + (x @ plane > (cuts[code] if len(cuts) > 1 else cuts[0]))
    return code


def nodes(rows: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Members (vec_id, node) of usable vectors; nodes: id (its place), node (least vec_id of equal vectors), exact (doubles), x (floats, norms made equal), members (the k + 1 least), norm (squared), cell (in the second tree); how many."""

    def read(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                ok = bool(v) and None not in v
                a = np.array(v, np.float64) if ok else None
                out.append((a + 0.0).tobytes() if ok and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "exact"])

    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null")
    usable = own.mapInArrow(read, "vec_id long, exact binary").filter("exact is not null").groupBy("vec_id").agg(F.min("exact").alias("exact"))
    usable = materialise(usable, "vectors")
    size = usable.groupBy(F.length("exact").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usable = usable.filter(F.length("exact") == (size["n"] if size else 0))
    least = usable.groupBy("exact").agg(F.min("vec_id").alias("node"))
    members = materialise(usable.join(least, "exact"), "members")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = members.select("node", "vec_id").withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))

    def norms(batches):
        for batch in batches:
            x = matrix(batch.column(1), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array((x * x).sum(1) if len(batch) else [], pa.float64())], ["node", "exact", "members", "norm"])

    distinct = members.filter("vec_id = node").select("node", "exact").join(few, "node")
    distinct = materialise(distinct.select("node", "exact", "members").mapInArrow(norms, "node long, exact binary, members array<long>, norm double"), "distinct")
    n, most = distinct.agg(F.count("*"), F.max("norm")).first()
    most = most or 0.0

    def levelled(exact, norm):
        x = matrix(exact, np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(most - np.asarray(norm), 0))]).astype(np.float32)

    drawn = distinct.filter(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(math.ceil(max(1, n) / SAMPLE))) == 0).select("exact", "norm").limit(2 * SAMPLE).toArrow()
    sample = levelled(drawn.column(0), drawn.column(1).to_numpy()) if len(drawn) else np.zeros((0, 1), np.float32)
    trees = [grow_tree(sample, n if len(sample) else 0, seed) for seed in range(DEALS)]

    def level(batches):
        for batch in batches:
            if len(batch):
                x = levelled(batch.column(1), batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3), *(pa.array(cells(x, t)) for t in trees)], ["node", "exact", "members", "x", "norm", "place", "cell"])

    laid = distinct.mapInArrow(level, "node long, exact binary, members array<long>, x binary, norm double, place long, cell long")
    order = ["place", F.xxhash64("node"), "node"]
    numbered = laid.repartitionByRange(work_blocks(laid, n), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    return members.select("vec_id", "node"), materialise(numbered.select("id", "node", "exact", "members", "x", "norm", "cell"), "nodes"), n


def chunks(batches, size: int):
    """The rows of batches again in batches of `size` to 2 * `size`, the last one whatever is left."""
    held, have = [], 0
    for batch in batches:
        held, have = [*held, batch], have + len(batch)
        while have >= 2 * size:
            whole = one_batch(held)
            yield whole.slice(0, size)
            held, have = [whole.slice(size)], have - size
    if have:
        yield one_batch(held)


def first_graph(points: DataFrame, n: int, k: int) -> DataFrame:
    """The nearest nodes inside blocks of consecutive nodes, once in the order of each tree."""
    m = max(1, math.ceil(k / DEALS))

    def run(batches):
        for batch in chunks(batches, BLOCK):
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            near_by = min(m, len(ids) - 1)
            if near_by < 1:
                continue
            for c in range(0, len(ids), 512):
                d = min(c + 512, len(ids))
                s = x[c:d] @ x.T
                s[np.arange(d - c), np.arange(c, d)] = -np.inf
                near = np.argpartition(-s, near_by - 1, 1)[:, :near_by]
                sims = np.take_along_axis(s, near, 1)
                yield by_owner(np.repeat(ids[c:d], near_by), ids[near].ravel(), sims.ravel(), np.zeros(sims.size, np.int8))

    parts = max(min(cores(points), math.ceil(n / BLOCK)), math.ceil(n / (16 * BLOCK)), 1)
    second = ["cell", F.xxhash64("id"), "id"]
    orders = [points.select("id", "x").repartitionByRange(parts, "id").sortWithinPartitions("id"), points.select("id", "x", "cell").repartitionByRange(parts, *second).sortWithinPartitions(*second).select("id", "x")]
    return orders[0].mapInArrow(run, GRAPH).unionByName(orders[1].mapInArrow(run, GRAPH))


def merge(places: DataFrame, blocks: int, k: int) -> DataFrame:
    """places: packed ones. One list a node, the k nearest. Places that come with no flag 1 are new: flag 0."""

    def run(batches):
        for batch in whole(batches):
            owner, near, sims, flags = unpacked(batch, 1)
            o, i, s, f = top(owner, near, sims, -flags, k)
            if len(o):
                yield by_owner(o, i, s, np.abs(f))

    return by_block(places, blocks).mapInArrow(run, GRAPH)


STOCK = "block int, kind int, asker int, ids array<long>, worst array<float>, x binary"  # kind 0: vectors; 1: what their lists lack room to ignore; 2: what a block asks for


def stock_row(block: int, kind: int, asker, ids: np.ndarray, worst=None, x=None):
    cells = ([block], [kind], [asker], [ids], [worst], [x])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.binary()), strict=True)], ["block", "kind", "asker", "ids", "worst", "x"])


def split(ids: np.ndarray, blocks: int):
    """For each block that ids are of: the block, and their places."""
    block = (ids >> ROW_BITS) % blocks
    order = np.argsort(block, kind="stable")
    starts = starts_of(block[order]) if len(ids) else np.zeros(0, np.int64)
    return [(int(block[p[0]]), p) for p in np.split(order, starts[1:]) if len(p)]


def stocked(points: DataFrame, blocks: int) -> DataFrame:
    """The vectors of points (id, x), many of a block in one row."""

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for block, at in split(ids, blocks):
                yield stock_row(block, 0, None, ids[at], x=x[at].tobytes())

    return points.select("id", "x").mapInArrow(run, STOCK)


def lowest(graph: DataFrame, blocks: int, k: int) -> DataFrame:
    """The least sim of each full list, many of a block in one row."""

    def run(batches):
        for batch in batches:
            offsets, _ = lists(batch.column(1))
            _, sims = lists(batch.column(1), np.float32)
            ids = batch.column(0).to_numpy()
            full = np.flatnonzero(np.diff(offsets) >= k)
            ids, worst = ids[full], sims[offsets[full + 1] - 1]
            for block, at in split(ids, blocks):
                yield stock_row(block, 1, None, ids[at], worst=worst[at])

    return graph.select("id", "sims").mapInArrow(run, STOCK)


def fetched(asks: DataFrame, stock: DataFrame, blocks: int) -> DataFrame:
    """asks: asker, ids. asker, ids, worst, x: the vectors that each asker asked for, a row for each block they are in.

    Vectors travel by the block, not one by one: with n nodes there are up to blocks^2 rows, where there were up to n * blocks.
    """

    def deal(batches):
        for batch in batches:
            offsets, ids = lists(batch.column(1))
            for r, asker in enumerate(batch.column(0).to_pylist()):
                own = ids[offsets[r] : offsets[r + 1]]
                for block, at in split(own, blocks):
                    yield stock_row(block, 2, asker, own[at])

    def answer(batches):
        held, told, asked = [], [], []
        for batch in batches:
            (offsets, ids), (w_offsets, worst) = lists(batch.column(3)), lists(batch.column(4), np.float32)
            for r, kind in enumerate(batch.column(1).to_pylist()):
                own = ids[offsets[r] : offsets[r + 1]]
                if kind == 0:
                    held.append((own, np.frombuffer(batch.column(5)[r].as_buffer(), np.float32).reshape(len(own), -1)))
                elif kind == 1:
                    told.append((own, worst[w_offsets[r] : w_offsets[r + 1]]))
                else:
                    asked.append((batch.column(2)[r].as_py(), own))
        if not asked:
            return
        ids, x = (np.concatenate([h[c] for h in held]) for c in range(2))
        held.clear()
        order = np.argsort(ids)
        ids, least = ids[order], np.full(len(ids), -np.inf, np.float32)
        for own, worst in told:
            least[np.searchsorted(ids, own)] = worst
        for asker, own in asked:
            at = np.searchsorted(ids, own)
            yield stock_row(asker, 0, asker, own, least[at], x[order[at]].tobytes())

    rows = stock.unionByName(asks.select("asker", "ids").mapInArrow(deal, STOCK))
    return by_block(rows, blocks).mapInArrow(answer, STOCK)


def received(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, x, worst of what fetched() gave one asker, by id. rows: its (ids, x, worst)."""
    ids, worst = (np.concatenate([r[c] for r in rows]) for c in (0, 2))
    x = np.concatenate([np.frombuffer(r[1], np.float32).reshape(len(r[0]), -1) for r in rows])
    order = np.argsort(ids)
    return ids[order], x[order], worst[order]


ADJACENT = "block int, id long, near array<long>, flags array<tinyint>"


def both_ways(graph: DataFrame, blocks: int, k: int) -> DataFrame:
    """Each node's list and the k nearest of those that list it, a place new if either is; and for each block a row without id: all nodes that nodes with a new place are beside, and they themselves."""

    def turn(batches):
        for batch in batches:
            owner, near, sims, flags = flat(batch, 0)
            if len(owner):
                yield packs(*top(near, owner, sims, flags, k), blocks)

    def join(batches):
        for batch in whole(batches):
            kind = batch.column(5).to_numpy()
            own, other = (unpacked(batch.take(pa.array(np.flatnonzero(kind == c))), 1) for c in range(2))
            other = top(*other, k)
            o, i, s, f = top(*(np.concatenate([a, b]) for a, b in zip(own, other, strict=True)), 2 * k)
            starts = starts_of(o) if len(o) else np.zeros(0, np.int64)
            sizes = np.diff([*starts, len(o)])
            busy = np.repeat(np.minimum.reduceat(f, starts) == 0, sizes) if len(o) else np.zeros(0, bool)
            wanted = np.unique(np.concatenate([o[busy], i[busy]]))
            block = np.full(len(starts) + 1, batch.column(0)[0].as_py(), np.int32)
            near = list_array(np.concatenate([i, wanted]), [*sizes, len(wanted)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([*o[starts].tolist(), None], pa.int64()), near, list_array(f, [*sizes, 0], pa.int8())], ["block", "id", "near", "flags"])

    own, other = packed(graph, blocks).withColumn("kind", F.lit(0)), graph.mapInArrow(turn, PACK).withColumn("kind", F.lit(1))
    return by_block(own.unionByName(other), blocks).mapInArrow(join, ADJACENT)


def compare(adjacent: DataFrame, stock: DataFrame, graph: DataFrame, blocks: int, k: int) -> DataFrame:
    """The join of neighbours with neighbours: the pairs, one of them new at least, that would improve a list. stock: stocked()."""

    def offers(target, other, s, worst):
        """For each target the OFFER nearest of the others that its list lacks room to ignore."""
        keep = s > worst[target][:, None]
        crowded = np.flatnonzero(np.count_nonzero(keep, 1) > OFFER)
        if len(crowded):
            own = s[crowded]
            keep[crowded] &= own >= np.partition(own, len(other) - OFFER, 1)[:, len(other) - OFFER, None]
        a, c = np.nonzero(keep)
        return target[a], other[c], s[a, c]

    def run(batches):
        vectors, tasks = [], []
        for batch in batches:
            if len(batch):
                kind = batch.column(1).to_numpy()
                (o, ids), (w, worst) = lists(batch.column(3)), lists(batch.column(5), np.float32)
                vectors += [(ids[o[r] : o[r + 1]], batch.column(6)[r].as_buffer(), worst[w[r] : w[r + 1]]) for r in np.flatnonzero(kind == 0)]
                tasks.append(batch.take(pa.array(np.flatnonzero(kind == 1))))
        if not vectors:
            return
        ids, x, worst = received(vectors)
        vectors.clear()
        rest = one_batch(tasks)
        offsets, near = lists(rest.column(3))
        _, flags = lists(rest.column(4), np.int8)
        at = np.searchsorted(ids, near).astype(np.int32)
        own = np.searchsorted(ids, rest.column(2).to_numpy()).astype(np.int32)
        parts, size, best = [], 0, None
        for n in range(len(own)):
            b, old = at[offsets[n] : offsets[n + 1]], flags[offsets[n] : offsets[n + 1]] != 0
            new, old = b[~old], np.append(b[old], own[n])
            both = np.concatenate([new, old])
            s = x[new] @ x[both].T
            np.fill_diagonal(s, -np.inf)
            parts += [offers(new, both, s, worst), offers(old, new, s[:, len(new) :].T, worst)]
            size += sum(len(p[0]) for p in parts[-2:])
            if size > max(1_000_000, len(best[0]) // 2 if best else 0) or n == len(own) - 1:
                o, i, v = (np.concatenate([p[c] for p in parts] + ([best[c]] if best else [])) for c in range(3))
                best, parts, size = top(o, i, v, np.zeros(len(o), np.int8), k), [], 0
                if len(best[0]):  # what a full list of offers has no room for is not offered any more
                    last = np.append(starts_of(best[0])[1:], len(best[0])) - 1
                    full = last[np.diff(last, prepend=-1) >= k]
                    worst[best[0][full]] = np.maximum(worst[best[0][full]], best[2][full])
        if best and len(best[0]):
            yield packs(ids[best[0]], ids[best[1]], best[2].astype(np.float32), best[3], blocks)

    none = F.lit(None)
    asks = adjacent.filter("id is null").select(F.col("block").alias("asker"), F.col("near").alias("ids"))
    vectors = fetched(asks, stock.unionByName(lowest(graph, blocks, k)), blocks)
    vectors = vectors.select("block", F.lit(0).alias("kind"), none.cast("long").alias("id"), F.col("ids").alias("near"), none.cast("array<tinyint>").alias("flags"), "worst", "x")
    busy = adjacent.filter(F.col("id").isNotNull() & F.array_contains("flags", F.lit(0).cast("tinyint")))
    rows = busy.select("block", F.lit(1).alias("kind"), "id", "near", "flags", none.cast("array<float>").alias("worst"), none.cast("binary").alias("x"))
    return by_block(vectors.unionByName(rows), blocks).mapInArrow(run, PACK)


def build(points: DataFrame, n: int, k=NEIGHBOURS, rounds=ROUNDS, enough=ENOUGH) -> DataFrame:
    """points: id, x, cell; n: how many. The graph: id, near, sims, flags. Rounds end, after one at least, when less than `enough` of all list places are new."""
    blocks = work_blocks(points, n)
    graph = materialise(merge(packed(first_graph(points, n, k), blocks), blocks, k), "graph")
    stock = materialise(stocked(points, blocks), "stock")
    for _ in range(rounds):
        adjacent = materialise(both_ways(graph, blocks, k), "adjacent")
        better = compare(adjacent, stock, graph, blocks, k)
        aged = graph.withColumn("flags", F.transform("flags", lambda _: F.lit(1).cast("tinyint")))
        new = materialise(merge(packed(aged, blocks).unionByName(better), blocks, k), "graph")
        drop(adjacent)
        drop(graph)
        graph = new
        if (new.agg(F.sum(F.size(F.filter("flags", lambda f: f == 0)))).first()[0] or 0) < enough * n * k:
            break
    drop(stock)
    return graph


STATE = "id long, near array<long>, sims array<float>, seen array<long>, go array<long>"


def entered(queries: DataFrame, points: DataFrame, entries=ENTRIES, gates=GATES) -> DataFrame:
    """The first state of a search: the best for each query of the `entries` nodes of largest norm, of which it goes to `gates`, and to itself."""
    held = points.orderBy(F.desc("norm"), "id").limit(entries).select("id", "x").toArrow().combine_chunks()  # so many rows at most
    first = queries.sparkSession.sparkContext.broadcast((held.column(0).to_numpy(), matrix(held.column(1).combine_chunks()) if len(held) else np.zeros((0, 1), np.float32)))

    def run(batches):
        ids, x = first.value
        for batch in batches:
            q, v = batch.column(0).to_numpy(), matrix(batch.column(1)).copy() if len(batch) else np.zeros((0, x.shape[1]), np.float32)
            v[:, -1] = 0
            s = v @ x.T
            s[q[:, None] == ids] = -np.inf
            best = np.argsort(-s, 1, kind="stable")[:, :gates]
            kept = [r[c != -np.inf] for r, c in zip(best, np.take_along_axis(s, best, 1))]
            near, sims, go = [ids[r] for r in kept], [s[i, r] for i, r in enumerate(kept)], [np.append(i, ids[r]) for i, r in zip(q, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(t)) for c, t in ((near, pa.int64()), (sims, pa.float32()), ([[]] * len(q), pa.int64()), (go, pa.int64())))], ["id", "near", "sims", "seen", "go"])

    return queries.select("id").join(points.select("id", "x"), "id").mapInArrow(run, STATE)


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, n: int, want=22, beam=BEAM, expand=EXPAND) -> DataFrame:
    """queries: id of nodes. Greedy search from each query's own node and from what entered() gives: id, near, the `want` nearest found and the node itself.

    Each hop looks at the neighbours, both ways, of the `expand` nearest nodes of the beam that haven't been looked at, until all of the `want` nearest
    have been. Nearness is that of the query with its last component zero, which is the inner product of the original vectors.
    """
    asked, beam = queries.count(), max(beam, want)
    pieces = max(1, min(cores(points), math.ceil(asked / 64)), math.ceil(asked / 1024))
    blocks = work_blocks(points, n)
    stock = materialise(stocked(points, blocks), "stock")
    adjacent = materialise(both_ways(graph, blocks, NEIGHBOURS), "adjacent").filter("id is not null").select("id", F.col("near").alias("beside"))
    state = materialise(entered(queries, points), "found")

    def gather(batches):
        """What each query of a piece has to score, and, in a row without id, what the piece has."""
        for batch in whole(batches):
            kind = batch.column(1).to_numpy()
            known, extra = batch.take(pa.array(np.flatnonzero(kind == 0))), batch.take(pa.array(np.flatnonzero(kind == 1)))
            offsets, beside = lists(extra.column(3))
            of: dict[int, list] = {}
            for r, q in enumerate(extra.column(2).to_pylist()):
                of.setdefault(q, []).append(beside[offsets[r] : offsets[r + 1]])
            k_off, k_near = lists(known.column(3))
            todo = []
            for r, q in enumerate(known.column(2).to_pylist()):
                todo.append(np.setdiff1d(np.concatenate([*of.get(q, []), np.zeros(0, np.int64)]), np.append(k_near[k_off[r] : k_off[r + 1]], q)))
            wanted = np.unique(np.concatenate([*todo, known.column(2).to_numpy()]))
            piece = pa.array(np.full(len(known) + 1, batch.column(0)[0].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([piece, pa.concat_arrays([known.column(2), pa.array([None], pa.int64())]), list_array(np.concatenate([*todo, wanted]), [*map(len, todo), len(wanted)], pa.int64())], ["piece", "id", "todo"])

    def score(batches):
        for batch in whole(batches):
            kind = batch.column(1).to_numpy()
            vec, known = (batch.take(pa.array(np.flatnonzero(kind == c))) for c in range(2))
            if not len(known):
                continue
            (v_off, v_flat), (_, v_worst) = lists(vec.column(3)), lists(vec.column(4), np.float32)
            ids, x, _ = received([(v_flat[a:b], vec.column(7)[r].as_buffer(), v_worst[a:b]) for r, (a, b) in enumerate(zip(v_off, v_off[1:]))])
            (n_off, n_flat), (t_off, t_flat), (g_off, g_flat), (w_off, w_flat) = (lists(known.column(c)) for c in (3, 5, 6, 8))
            _, s_flat = lists(known.column(4), np.float32)
            out = []
            for r, q in enumerate(known.column(2).to_pylist()):
                todo = t_flat[t_off[r] : t_off[r + 1]]
                centre = x[np.searchsorted(ids, q)].copy()
                centre[-1] = 0
                near = np.concatenate([n_flat[n_off[r] : n_off[r + 1]], todo])
                sims = np.concatenate([s_flat[n_off[r] : n_off[r + 1]], x[np.searchsorted(ids, todo)] @ centre])
                best = np.lexsort((near, -sims))[:beam]
                near, sims = near[best], sims[best]
                seen = np.concatenate([g_flat[g_off[r] : g_off[r + 1]], w_flat[w_off[r] : w_off[r + 1]]])
                fresh = ~np.isin(near, seen)
                out.append((q, near, sims, seen, near[fresh][:expand] if fresh[:want].any() else near[:0]))
            columns = [list_array(np.concatenate([o[c] for o in out]), [len(o[c]) for o in out], t) for c, t in ((1, pa.int64()), (2, pa.float32()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *columns], ["id", "near", "sims", "seen", "go"])

    piece = F.pmod(F.xxhash64("id", F.lit("piece")), F.lit(pieces)).cast("int").alias("piece")
    blank = {"near": "array<long>", "sims": "array<float>", "todo": "array<long>", "seen": "array<long>", "x": "binary", "go": "array<long>"}

    def shaped(df, kind, piece=piece, **cols):
        return df.select(piece, F.lit(kind).alias("kind"), "id", *(F.col(cols[c]).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in blank.items()))

    ended = None
    while not state.isEmpty():
        step = state.select(F.col("id").alias("q"), F.explode("go").alias("id")).join(adjacent, "id").select(F.col("q").alias("id"), "beside")
        rows = shaped(state, 0, near="near").unionByName(shaped(step, 1, near="beside")).select("piece", "kind", "id", "near")
        lists_ = materialise(by_block(rows, pieces, "piece").mapInArrow(gather, "piece int, id long, todo array<long>"), "todo")
        wanted = fetched(lists_.filter("id is null").select(F.col("piece").alias("asker"), F.col("todo").alias("ids")), stock, blocks)
        live = state.join(lists_.filter("id is not null").select("id", "todo"), "id")
        rows = shaped(wanted.withColumn("id", F.lit(None).cast("long")), 0, F.col("block").alias("piece"), near="ids", sims="worst", x="x").unionByName(shaped(live, 1, near="near", sims="sims", todo="todo", seen="seen", go="go"))
        new = materialise(by_block(rows, pieces, "piece").mapInArrow(score, STATE), "found")
        drop(lists_)
        state, finished = new.filter("size(go) > 0"), new.filter("size(go) = 0").select("id", "near")
        ended = finished if ended is None else ended.unionByName(finished)
    found = ended if ended is not None else state.select("id", "near")
    return found.select("id", F.concat(F.array("id"), F.slice("near", 1, want)).alias("near"))


def rank(found: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """found: id, near. Scores every member of the nodes found in double precision: node, ids, scores, the k + 1 best, ties by vec_id."""

    def run(batches):
        for batch in grouped(batches, 1):
            q, other = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, members, node = matrix(batch.column(2), np.float64), batch.column(3).to_pylist(), batch.column(4).to_numpy()
            starts = starts_of(q)
            out = []
            for a, b in zip(starts, [*starts[1:], len(q)], strict=True):
                me = a + int(np.flatnonzero(other[a:b] == q[a])[0])
                scores = x[a:b] @ x[me]
                best = sorted((-s, m) for s, row in zip(scores.tolist(), members[a:b], strict=True) for m in row)[: k + 1]
                out.append((int(node[me]), [m for _, m in best], [-s for s, _ in best]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["node", "ids", "scores"])

    rows = found.select(F.col("id").alias("q"), F.explode("near").alias("id")).join(points.select("id", "exact", "members", "node"), "id").select("q", "id", "exact", "members", "node")
    return rows.repartition("q").sortWithinPartitions("q").mapInArrow(run, "node long, ids array<long>, scores array<double>")


def neighbours(rows: DataFrame, is_query, k=20, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query(vec_id) holds for; any k, of copies as of others.

    Nearness is the inner product. Vectors that are null, empty, zero, hold null or non-finite components or aren't of the commonest length take no part, nor
    do null ids; of an id's several vectors the least in byte order counts. Ties go to the smaller vec_id. Fewer candidates give fewer
    rows; no rows give none. Other columns are ignored.
    """
    members, points, n = nodes(rows, id_col, vec_col, k)
    asked = materialise(members.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "node"), "asked")
    graph = build(points, n)
    queries = points.select("id", "node").join(asked.select("node").distinct(), "node", "left_semi").select("id")
    best = rank(search(graph, points, queries, n, want=k + SPARE), points, k)
    others = F.filter(F.arrays_zip("ids", "scores"), lambda z: z["ids"] != F.col("query_id"))
    out = asked.join(best, "node").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "z"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))


def op2_ann(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
