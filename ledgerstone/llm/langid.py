"""Language identification by a linear-chain conditional random field over words.

Word emissions come from affixes, character n-grams, the word itself and a lexicon (hashed word counts by
language over the whole training fold); transitions are learned on code-switched sequences stitched from
runs of training documents. Forward-backward labels every word of every whole text; a document's language
is the one with the largest mean marginal.

Weights are fitted on at most `max_docs` documents; lexicon counts cover the whole training fold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WEIGHTS, LEXICON = 1 << 18, 1 << 17
STEPS = 96  # words in a block of the chain; blocks are joined exactly
WIDTH = 24  # characters of a word that features see: of longer words the first and last twelve
WORD = re.compile(r"[^\W\d_]+")


def in_training(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def words_of(text: str) -> list[str]:
    """The lower-case words: runs of letters. Numerals such as fractions and Roman ones are no letters."""
    found = WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found for w in ("".join(c if c.isalpha() else " " for c in x)).split()]


def drawn_runs(text: str, seed: int, runs: int, words: int) -> list[list[str]]:
    """Up to `runs` runs of fewer than `words` words each from anywhere in the whole text."""
    found, rng = words_of(text), np.random.default_rng(seed)
    if len(found) < 4:
        return []
    sizes = np.minimum(rng.integers(4, words, runs), len(found))
    return [[short(w) for w in found[a : a + n]] for n, a in ((n, int(rng.integers(len(found) - n + 1))) for n in sizes.tolist())]


def short(word: str) -> str:
    return word if len(word) <= WIDTH else word[: WIDTH // 2] + word[-WIDTH // 2 :]


def code_points(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)


def fold(codes: np.ndarray, there: np.ndarray) -> np.ndarray:
    whole = np.zeros(len(codes), np.uint64)
    for i in range(WIDTH):
        whole = np.where(there[:, i], whole * np.uint64(1000003) + codes[:, i], whole)
    return whole


def index(x: np.ndarray, kind: int, of=WEIGHTS) -> np.ndarray:
    return (((x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - of.bit_length() + 1)).astype(np.int64)


def lexicon_bucket(words: list[str]) -> np.ndarray:
    codes = code_points(words)
    return index(fold(codes, codes != 0), 41, LEXICON)


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices (words x kinds and places) into WEIGHTS, which of them are there, and each word's lexicon bucket.

    Features are the word, its beginnings and endings of 1 to 4 letters, and its bigrams and trigrams, edges included.
    """
    codes = code_points(words)
    n = (codes != 0).sum(1)
    place = np.arange(WIDTH)
    there = place < n[:, None]
    whole = fold(codes, there)
    edged = np.zeros((len(words), WIDTH + 2), np.uint64)
    edged[:, 0] = 2
    edged[:, 1:-1] = codes
    edged[np.arange(len(words)), n + 1] = 3
    at21 = np.uint64(1 << 21)
    pairs = codes[:, :-1] * at21 + codes[:, 1:]
    threes = (edged[:, :-2] * at21 + edged[:, 1:-1]) * at21 + edged[:, 2:]
    found, real = [index(whole, 1)[:, None]], [np.ones((len(words), 1), bool)]
    for k in range(1, 5):
        begin, end = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        rows = np.arange(len(words))
        for j in range(k):
            begin = begin * at21 + codes[:, j]
            end = end * at21 + codes[rows, np.maximum(n - 1 - j, 0)]
        found += [index(begin, 10 + k)[:, None], index(end, 20 + k)[:, None]]
        real += [(n >= k)[:, None]] * 2
    found += [index(pairs, 31), index(threes, 32)]
    real += [there[:, 1:], there]
    return np.concatenate(found, 1), np.concatenate(real, 1), index(whole, 41, LEXICON)


@dataclass
class Crf:
    langs: list[str]
    lexicon: np.ndarray  # LEXICON x langs: log share of a word's bucket, smoothed and centred
    weights: np.ndarray  # WEIGHTS x langs
    mix: np.ndarray  # langs x langs: what the lexicon adds
    move: np.ndarray  # langs x langs: log weight of going from one language to the next
    scale: float = 1.0

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of log weights for each word."""
        found, real, lex = hashes(words)
        total = np.empty((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            total[:, j] = np.where(real, self.weights[:, j][found], 0).sum(1)
        return total / np.sqrt(real.sum(1))[:, None] + self.lexicon[lex] @ self.mix


def marginals(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward-backward. emit: sequences one after another, words x langs, positive weights; length: words of each sequence; move: positive.

    Sequences are cut into blocks of STEPS words, worked on all at once. A first pass gets each block's transfer matrices, with which
    the messages at block borders are found one block after another; a second pass then runs inside the blocks. This is exact.
    """
    n, k = emit.shape
    emit, move = emit.astype(np.float32, copy=False), move.astype(np.float32)
    per = -(-length // STEPS)
    first = np.concatenate([[0], np.cumsum(per)])
    at = np.concatenate([[0], np.cumsum(length)])
    blocks = int(first[-1])
    owner = np.repeat(np.arange(len(length)), per)
    rank = np.arange(blocks) - first[owner]
    start = at[owner] + rank * STEPS
    size = np.minimum(at[owner + 1] - start, STEPS)
    by_size = np.argsort(-size, kind="stable")  # the blocks that reach a step come first
    start, size = start[by_size], size[by_size]
    on = np.searchsorted(-size, -np.arange(1, STEPS + 1), side="right")
    place = np.empty(blocks, np.int64)
    place[by_size] = np.arange(blocks)
    through = np.broadcast_to(np.eye(k, dtype=np.float32), (blocks, k, k)).copy()
    for t in range(STEPS):
        m = on[t]
        if not m:
            break
        step = (through[:m].reshape(-1, k) @ move).reshape(m, k, k) * emit[start[:m] + t][:, None, :]
        if t % 2:
            step /= step.sum((1, 2), keepdims=True)
        through[:m] = step
    through = through[place]
    into = np.ones((blocks, k), np.float32) / k  # forward messages into each block, not yet moved
    out = np.ones((blocks, k), np.float32)  # backward messages after each block's last word
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(int(per.max(initial=0)) + 1))
    for r in range(1, len(cuts) - 1):
        b = by_rank[cuts[r] : cuts[r + 1]]
        got = np.einsum("bi,bij->bj", into[b - 1], through[b - 1])
        into[b] = got / got.sum(1, keepdims=True)
    for r in range(len(cuts) - 2, 0, -1):
        b = by_rank[cuts[r] : cuts[r + 1]]
        got = np.einsum("bij,bj->bi", through[b], out[b])
        out[b - 1] = got / got.sum(1, keepdims=True)
    gamma = np.empty((n, k), np.float32)
    a = into[by_size]
    for t in range(STEPS):
        m = on[t]
        if not m:
            break
        here = start[:m] + t
        step = (a[:m] @ move) * emit[here]
        step /= step.sum(1, keepdims=True)
        a[:m] = gamma[here] = step
    b, back = out[by_size], move.T.copy()
    for t in range(STEPS - 1, -1, -1):
        m = on[t]
        if not m:
            continue
        here = start[:m] + t
        gamma[here] *= b[:m]
        step = (b[:m] * emit[here]) @ back
        step /= step.sum(1, keepdims=True)
        b[:m] = step
    gamma /= gamma.sum(1, keepdims=True)
    return gamma


class Labeller:
    """Labels whole texts; remembers words up to a bound and works in blocks of bounded size."""

    def __init__(self, crf: Crf, remember=500_000, block=300_000):
        self.crf, self.remember, self.block = crf, remember, block
        self.forget()

    def forget(self):
        self.ids: dict[str, int] = {}
        self.emit = np.ones((1 << 12, len(self.crf.langs)), np.float32)

    def learn_words(self, new: list[str]):
        while len(self.ids) + len(new) > len(self.emit):
            self.emit = np.concatenate([self.emit, np.ones_like(self.emit)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            e = self.crf.emissions([short(w) for w in part])
            n = len(self.ids)
            self.emit[n : n + len(part)] = np.exp(np.maximum(e - e.max(1, keepdims=True), -12))
            self.ids.update(zip(part, range(n, n + len(part)), strict=True))

    def marginals(self, docs: list[list[str]], length: np.ndarray) -> np.ndarray:
        if len(self.ids) > self.remember:
            self.forget()
        if new := set(chain.from_iterable(docs)).difference(self.ids):
            self.learn_words(list(new))
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs)), np.int64, int(length.sum()))
        return marginals(self.emit[ids], length, np.exp(self.crf.move))

    def texts(self, texts: list[str]):
        """(language, score) of each text; ("und", 0.0) without letters."""
        out, waiting, size = [], [], 0
        for text in texts:
            waiting.append(words_of(text or ""))
            size += len(waiting[-1])
            if size >= self.block:
                out += self._label(waiting)
                waiting, size = [], 0
        return out + self._label(waiting)

    def _label(self, docs):
        length = np.array([len(d) for d in docs], np.int64)
        if not length.sum():
            return [("und", 0.0)] * len(docs)
        gamma = self.marginals(docs, length)
        full = np.flatnonzero(length)
        starts = np.concatenate([[0], np.cumsum(length[full])[:-1]])
        share = np.add.reduceat(gamma, starts, 0, dtype=float) / length[full][:, None]
        out = [("und", 0.0)] * len(docs)
        for i, row in zip(full, share, strict=True):
            b = int(row.argmax())
            out[i] = (self.crf.langs[b], float(min(1.0, max(0.0, row[b]))))
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        """Every word of a code-switched text with its likeliest language."""
        words = words_of(text or "")
        if not words:
            return []
        best = self.marginals([words], np.array([len(words)])).argmax(1)
        return [(w, self.crf.langs[b]) for w, b in zip(words, best, strict=True)]


def count_lexicon(train: DataFrame, langs: list[str]) -> np.ndarray:
    """Word counts in LEXICON hash buckets by language, over every row of train (text, lang)."""
    at = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros(LEXICON * len(langs), np.int64)
        for batch in batches:
            counts: dict[str, Counter] = {x: Counter() for x in langs}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(words_of(text))
            for lang, found in counts.items():
                if found:
                    np.add.at(total, lexicon_bucket([short(w) for w in found]) * len(langs) + at[lang], list(found.values()))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(total[full])], ["at", "n"])

    rows = train.select("text", "lang").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEXICON * len(langs))
    counts[rows["at"].to_numpy(np.int64)] = rows["n"]
    counts = counts.reshape(LEXICON, len(langs))
    rate = counts / np.maximum(counts.sum(0), 1) * 1e6
    log = np.log(rate + 0.5)
    return (log - log.mean(1, keepdims=True)).astype(np.float32)


def stitched(runs: list[list[list[str]]], y: np.ndarray, n: int, rng, words=24):
    """n sequences of parts of the documents' runs, drawn at random: languages switch within most of them."""
    usable = [i for i in np.arange(len(runs)) if runs[i]]
    if not usable:
        return [], np.zeros((0, words), int)
    by_lang = [[i for i in usable if y[i] == k] for k in range(int(y.max()) + 1)]
    present = [k for k, x in enumerate(by_lang) if x]
    tokens, labels = [], np.empty((n, words), int)
    for s in range(n):
        row: list[str] = []
        while len(row) < words:
            k = present[rng.integers(len(present))]
            i = by_lang[k][rng.integers(len(by_lang[k]))]
            run = runs[i][rng.integers(len(runs[i]))]
            size = min(int(rng.integers(3, words)), words - len(row), len(run))
            a = int(rng.integers(len(run) - size + 1))
            labels[s, len(row) : len(row) + size] = k
            row += run[a : a + size]
        tokens.append(row)
    return tokens, labels


def fit(crf: Crf, tokens: list[list[str]], labels: np.ndarray, rng, rounds=4, batch=64, rate=0.1) -> None:
    """Gradient ascent (AdaGrad) on the conditional likelihood of whole label sequences."""
    n, k = len(tokens), len(crf.langs)
    if not n:
        return
    steps = labels.shape[1]
    words = sorted({w for row in tokens for w in row})
    number = dict(zip(words, range(len(words)), strict=True))
    found, real, buckets = hashes(words)
    ids = np.array([[number[w] for w in row] for row in tokens])
    g_w, g_mix, g_move = np.full_like(crf.weights, 1e-2), np.full((k, k), 1e-2), np.full((k, k), 1e-2)
    onehot = np.eye(k)
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            here = ids[rows].ravel()
            size = real[here].sum(1)
            flat = found[here][real[here]]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            lex = crf.lexicon[buckets[here]].astype(float)
            score = np.add.reduceat(crf.weights[flat], starts, 0) / np.sqrt(size)[:, None] + lex @ crf.mix
            emit = np.exp(score - score.max(1, keepdims=True)).reshape(len(rows), steps, k)
            move = np.exp(crf.move)
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            a = np.ones((len(rows), k)) / k
            for t in range(steps):
                a = (a @ move if t else a) * emit[:, t]
                a /= a.sum(1, keepdims=True)
                alpha[:, t] = a
            b = np.ones((len(rows), k))
            for t in range(steps - 2, -1, -1):
                b = (b * emit[:, t + 1]) @ move.T
                b /= b.sum(1, keepdims=True)
                beta[:, t] = b
            gamma = alpha * beta
            gamma /= gamma.sum(2, keepdims=True)
            truth = onehot[labels[rows]]
            pair = alpha[:, :-1, :, None] * move * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            d_move = (truth[:, :-1, :, None] * truth[:, 1:, None, :] - pair).sum((0, 1)) / len(rows)
            d = (truth - gamma).reshape(-1, k)
            d_mix = lex.T @ d / len(rows)
            spread = np.repeat(d / np.sqrt(size)[:, None], size, 0)
            used, back = np.unique(flat, return_inverse=True)
            d_w = np.stack([np.bincount(back, spread[:, j], len(used)) for j in range(k)], 1) - 1e-3 * crf.weights[used]
            g_w[used] += d_w**2
            crf.weights[used] += rate * d_w / np.sqrt(g_w[used])
            for x, dx, g in ((crf.mix, d_mix, g_mix), (crf.move, d_move, g_move)):
                g += dx**2
                x += rate * dx / np.sqrt(g)


def train(docs: DataFrame, max_docs=1200, sequences=4000, runs=12, words=24, seed=7, id_col="doc_id", text_col="text", lang_col="lang") -> Crf | None:
    """None if no row may be learned from. Languages are the non-null values of lang in the training fold.

    Weights are fitted on max_docs documents: on `runs` runs of fewer than `words` words of each, drawn on the executors from anywhere in the whole
    text, so that what is gathered is bounded and a late change of language is learned from. Lexicon counts cover all rows and whole texts.
    """
    fold = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(in_training(F.col("id"))).dropna()
    sizes = {r["lang"]: r["count"] for r in fold.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    crf = Crf(langs, count_lexicon(fold, langs), np.zeros((WEIGHTS, len(langs))), np.eye(len(langs)) * 0.1, np.eye(len(langs)))
    each = max(1, max_docs // len(langs))
    # A hash lets about twice as many through as are wanted, of which the first are taken: what is gathered is bounded, whatever the input.
    dice = F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1 << 30))
    through = F.coalesce(*(F.when(F.col("lang") == x, dice <= min(1.0, 2 * each / n) * (1 << 30)) for x, n in sizes.items()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "id", F.to_json("runs")))

    def draw(batches):
        for batch in batches:
            found = [drawn_runs(t, dice, runs, words) for t, dice in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.list_(pa.string())))], ["lang", "id", "dice", "runs"])

    kind = fold.schema["id"].dataType.simpleString()
    drawn = fold.withColumn("dice", dice).filter(through).select("lang", "id", "dice", "text").mapInArrow(draw, f"lang string, id {kind}, dice long, runs array<array<string>>")
    parts = drawn.withColumn("place", place).filter(F.col("place") <= each).orderBy("lang", "place").select("lang", "runs").collect()
    held, y = [r["runs"] for r in parts], np.array([langs.index(r["lang"]) for r in parts], int)
    rng = np.random.default_rng(seed)
    tokens, labels = stitched(held, y, sequences, rng, words)
    fit(crf, tokens, labels, rng)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def predict(docs: DataFrame, crf: Crf | None = None, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Null texts, empty ones and those without a letter get "und" and 0; so does everything if no language can be learned. Ties go to the
    language first in code-point order. Null ids are never learned from and not held out. Repeated rows are labelled each. Other columns
    are ignored. No rows give no rows.
    """
    crf = crf or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(~in_training(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches):
        labeller = Labeller(crf) if crf else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = labeller.texts(texts) if labeller else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return own.mapInArrow(run, schema)


def op5_langid(spark, sf_dir):
    return predict(table(spark, sf_dir, "documents"))
