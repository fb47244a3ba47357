"""Toxicity by noisy-channel deobfuscation.

A character model, of five letters with trigrams behind, is counted over the whole corpus. Tokens that look obfuscated (leetspeak inside
words, letters repeated three times or more) and stretches of characters set apart by blanks, dots or dashes span a
lattice of readings, in which a gap may be nothing or part two words; Viterbi decoding under the character model and a
channel model picks one. Words of the restored text then
score a document by weights learned from labels: words and word beginnings that occur in toxic documents
in many different contexts, and hardly in others.

The labelled sample is bounded by `max_labelled` rows. Character counts cover all rows, scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, table

# The model's letters, and what each symbol may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøùúûüßœÿãõ"
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
BOUND, OTHER, SIZE = 0, 63, 64
CELL_BITS = 20
CELLS, BACK = 1 << CELL_BITS, 5.0
WORD = re.compile(r"[^\W\d_]+")
LEET = re.compile(r"[^\W\d_][0-9@$!|+€(]+[^\W\d_]|^[0-9@$!|+€(]{1,2}[^\W\d_]{2}|[^\W\d_]{2}[0-9@$€]+$")
REPEAT = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$€])(?:[ \t]+|[.*_-])){3,}(?:[^\W_]|[@$€])(?!\w)")
GAP = re.compile(r"[ \t]+|[.*_-]")
# Costs of the channel for a gap: nothing there, or a new word. A wide gap among narrow ones parts words.
GLUED, PARTED, WIDE_GLUED = 0.0, -1.0, -9.0
STEMS = (3, 4, 5, 6)

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}


def letter_codes() -> np.ndarray:
    """Code point -> letter class, for code points below 0x400; later ones are looked at as other letters."""
    codes = np.full(0x400, BOUND, np.int64)
    for i in range(0x400):
        c = chr(i)
        codes[i] = _CODE.get(c.lower(), OTHER) if c.isalpha() else BOUND
    return codes


def gram_counts(texts, total=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, added to total, of letter-class trigrams, and by hash of those of five letters and of the four before each letter; runs of non-letters count as one boundary."""
    three, five, four = total or (np.zeros(SIZE**3, np.int64), np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64))
    codes = letter_codes()
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        x = codes[np.minimum(points, 0x3FF)]
        x = np.concatenate([[BOUND] * 4, x, [BOUND]])
        x = x[np.concatenate([[True] * 4, (x[4:] != BOUND) | (x[3:-1] != BOUND)])]
        if len(x) > 4:
            three += np.bincount((x[2:-2] * SIZE + x[3:-1]) * SIZE + x[4:], minlength=SIZE**3)
            before = ((x[:-4] * SIZE + x[1:-3]) * SIZE + x[2:-2]) * SIZE + x[3:-1]
            four += np.bincount(cell(before), minlength=CELLS)
            five += np.bincount(cell(before * SIZE + x[4:]), minlength=CELLS)
    return three, five, four


def cell(gram):
    """The hash cell of a number of up to 30 bits."""
    return (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - CELL_BITS


class CharModel:
    """log P(letter | the four before it): as counted for five letters, where seen, with what is left spread as the trigrams have it. Fixed size: 64^3 and twice 2^CELL_BITS numbers."""

    def __init__(self, three: np.ndarray, five: np.ndarray, four: np.ndarray):
        three = three.reshape(SIZE, SIZE, SIZE).astype(float)
        two = three.sum(0)
        one = two.sum(0) + 0.5
        p2 = (two + 20 * one / one.sum()) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
        self.three, self.five, self.four = np.log(p3).astype(np.float32).ravel(), five.astype(np.float32), four.astype(np.float32)
        self.views, self.known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"views": None, "known": {}}

    def step(self, history: int, k: int) -> tuple[float, int]:
        """log P(k) after a history of four letter classes, and the history after it. Remembers up to a bound."""
        gram = history * SIZE + k
        low = self.known.get(gram)
        if low is not None:
            return low, gram & SIZE**4 - 1
        if self.views is None:
            self.views = tuple(map(memoryview, (self.three, self.five, self.four)))
        three, five, four = self.views
        low = three[gram & SIZE**3 - 1]
        n = four[cell(history)]
        if n:
            low = math.log((five[cell(gram)] + BACK * math.exp(low)) / (n + BACK))
        if len(self.known) >= 100_000:
            self.known.clear()
        self.known[gram] = low
        return low, gram & SIZE**4 - 1


def _joined(column, limit=1 << 19):
    """Texts of an Arrow column put together, in blocks of about half a million characters."""
    block, size = [], 0
    for text in column.to_pylist():
        if text:
            block.append(text)
            size += len(text)
            if size >= limit:
                yield "  ".join(block)
                block, size = [], 0
    if block:
        yield "  ".join(block)


def char_model(docs: DataFrame, text_col="text") -> CharModel:
    """Counted over every row. Tasks report only cells that they have counted in, so that what is gathered grows with the corpus up to the size of the model."""

    def count(batches):
        total = None
        for batch in pieces(batches):
            total = gram_counts(_joined(batch.column(0)), total)
        for kind, counts in enumerate(total or ()):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["kind", "at", "n"])

    rows = docs.select(text_col).mapInArrow(count, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (rows.column(i).to_numpy() for i in range(3))
    counts = [np.zeros(size, np.int64) for size in (SIZE**3, CELLS, CELLS)]
    for i, total in enumerate(counts):
        total[at[kind == i]] = n[kind == i]
    return CharModel(*counts)


def readings_of(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, at what cost."""
    if c.isalpha():
        return [(c * n, 0.0)] if n < 3 else [(c, 0.0), (c * 2, -0.7)]
    if c in STANDS_FOR:
        return [(x * m, -1.0 - math.log(len(STANDS_FOR[c])) - (m > 1)) for x in STANDS_FOR[c] for m in ({1, min(n, 2)})] + [("", -12.0 if c.isdigit() else -6.0)]
    return [("", -1.0)]


def viterbi(lattice: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The likeliest way through a lattice of (reading, cost) alternatives. A blank in a reading ends a word."""
    best = {0: (0.0, None)}
    for readings in lattice:
        after: dict = {}
        for history, (score, path) in best.items():
            for text, cost in readings:
                h, s = history, score + cost
                for x in text:
                    step, h = model.step(h, BOUND if x == " " else _CODE.get(x, OTHER))
                    s += step
                if h not in after or after[h][0] < s:
                    after[h] = (s, (path, text))
        best = after
    _, path = max(((s + model.step(h, BOUND)[0], p) for h, (s, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a lower-case token: symbols may stand for letters or be noise, runs of a letter may be shorter."""
    runs: list[tuple[str, int]] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    return viterbi([readings_of(c, n) for c, n in runs], model)


def spaced_lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """The lattice of a lower-case stretch of single characters: each may be read in any way, each gap be nothing or the end of a word."""
    gaps, at, out = GAP.findall(stretch), 0, []
    narrow = min(map(len, gaps), default=0)
    for gap in gaps:
        cut = stretch.index(gap, at)
        glued = GLUED if len(gap) == narrow else WIDE_GLUED
        out += [readings_of(stretch[at:cut], 1), [("", glued), (" ", PARTED if glued == GLUED else 0.0)]]
        at = cut + len(gap)
    return [*out, readings_of(stretch[at:], 1)]


def looks_hidden(token: str) -> bool:
    return bool(LEET.search(token) or REPEAT.search(token))


def unspaced(stretch: str, model: CharModel) -> str:
    """A stretch of single characters as the words that Viterbi cuts it into; one with hardly a letter stays."""
    low = stretch.lower()
    return viterbi(spaced_lattice(low), model) if sum(c.isalpha() for c in low) >= 3 else stretch


def spaced_words(text: str, model: CharModel) -> list[str]:
    """The words of all stretches of characters set apart by blanks, dots or dashes."""
    return [w for m in SPACED.finditer(text) for w in WORD.findall(unspaced(m[0], model))]


def restore(text: str, model: CharModel) -> str:
    """The whole text with its hidden words restored."""
    text = SPACED.sub(lambda m: unspaced(m[0], model), text)
    return re.sub(r"\S+", lambda m: decode(m[0].lower(), model) if looks_hidden(m[0].lower()) else m[0], text)


def words_of(token: str, model: CharModel) -> list[str]:
    """The lower-case words of a token as they stand, and restored if it looks hidden."""
    words = WORD.findall(token)
    if looks_hidden(token):
        words += WORD.findall(decode(token, model))
    return words


def features(word: str):
    """A word and its beginnings."""
    yield "=" + word
    for n in STEMS:
        if len(word) > n:
            yield word[:n]


def in_training(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def learn(docs: DataFrame, labels: DataFrame, model: CharModel, max_labelled=40_000, contexts=6, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[dict[str, float], np.ndarray]:
    """Feature -> weight, and the coefficients of Scorer.summary(). Uses at most max_labelled labelled rows, drawn by hash of the id, so that what is broadcast and gathered is bounded.

    A feature counts if toxic documents hold it in `contexts` different contexts at least (copies share their contexts, so that what a copied
    document happens to say doesn't count) and if it is 20 times likelier there than elsewhere. Without rows of both labels there are no features, and nothing is toxic.
    """
    drawn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")).filter(in_training(F.col("id")))
    # A hash lets little more through than is wanted, so that what is sorted is bounded too.
    through = min(1.0, 1.3 * max_labelled / max(1, drawn.count()))
    drawn = drawn.filter(F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1 << 30)) <= through * (1 << 30)).orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def observe(batches):
        for part in pieces(batches):
            rows: Counter = Counter()
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tokens, spaced = text.lower().split(), spaced_words(text, model)
                read = [(words_of(t, model), a, b) for a, t, b in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False)]
                read += [([w], a, b) for a, w, b in zip(["", *spaced], spaced, [*spaced[1:], ""], strict=False)]
                rows.update((f, y, 0) for f in {"", *(f for w in {w for words, _, _ in read for w in words} for f in features(w))})
                if y:  # contexts are tokens as they stand, so that what decoding makes of the neighbours has no part in it
                    rows.update({(f, y, hash_of(a, b)) for words, a, b in read for w in words for f in features(w)})
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(rows.values()), pa.int64())], ["f", "y", "context", "n"])

    sample = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "id").select("text", "y"), "toxic-sample")
    toxic, document = F.col("y") == 1, F.col("context") == 0
    pairs = sample.mapInArrow(observe, "f string, y int, context long, n long").groupBy("f", "y", "context").agg(F.sum("n").alias("n"))
    sums = pairs.groupBy("f").agg(F.count_if(toxic & ~document).alias("contexts"), F.sum(F.when(toxic & document, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(~toxic, F.col("n")).otherwise(0)).alias("c"))
    sums = materialise(sums.filter((F.col("f") == "") | (F.col("contexts") >= contexts)), "toxic-features")
    size = sums.filter("f = ''").first()
    if not size or not size["t"] or not size["c"]:
        return {}, np.array([-3.0, 0, 0, 0, 0])
    t, c = size["t"], size["c"]
    weight = F.log((F.least("t", "contexts") + 0.5) / (t + 1.0)) - F.log((F.col("c") + 0.5) / (c + 1.0))
    strong = sums.filter("f <> ''").withColumn("weight", weight).filter(F.col("weight") >= math.log(20))
    weights = {r["f"]: r["weight"] for r in strong.collect()}

    def summarise(batches):
        scorer = Scorer(weights, model)
        for batch in pieces(batches):
            x = np.array([scorer.summary(t) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column(1)], [*"abcd", "y"])

    rows = sample.mapInArrow(summarise, "a double, b double, c double, d double, y int").toPandas()
    return weights, fit_logistic(rows[[*"abcd"]].to_numpy(), rows["y"].to_numpy(float))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge=0.05, steps=40) -> np.ndarray:
    """Intercept and coefficients by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def hash_of(*words: str) -> int:
    import zlib

    return zlib.crc32("\x1f".join(words).encode("utf-8", "replace")) + 1


class Scorer:
    """Scores texts by the weights of their tokens; remembers the tokens it has seen, up to a bound."""

    def __init__(self, weights: dict[str, float], model: CharModel, coefficients=None, remember=200_000):
        self.weights, self.model, self.coefficients, self.remember, self.known = weights, model, coefficients, remember, {}

    def token(self, token: str) -> float:
        found = max((self.weights.get(f, 0.0) for w in words_of(token, self.model) for f in features(w)), default=0.0)
        if len(self.known) >= self.remember:
            self.known.clear()
        if len(token) <= 40:
            self.known[token] = found
        return found

    def summary(self, text: str) -> tuple[float, float, float, float]:
        """The largest weight, the sum of the others, how many tokens have one, and how many a hundred tokens that is."""
        known, hits, tokens = self.known, [], set(text.lower().split())
        for token in tokens:
            w = known.get(token)
            if w is None:
                w = self.token(token)
            if w:
                hits.append(w)
        if SPACED.search(text):
            hits += [w for x in spaced_words(text, self.model) if (w := self.token(x))]
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        most = max(hits)
        return most, math.log1p(sum(hits) - most), math.log1p(len(hits)), math.log1p(100 * len(hits) / (len(tokens) + 20))

    def score(self, text: str) -> float:
        a, *b = self.coefficients
        z = a + sum(x * y for x, y in zip(b, self.summary(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, labels: DataFrame, max_labelled=40_000, id_col="doc_id", text_col="text", label_col="toxic", keep=()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, and the columns in keep.

    Null and empty texts score as texts without hits, under one half. Null ids are never learned from and not held out. Repeated rows are
    scored each; labels of an id count once, as toxic if any of them says so. Without labels nothing is toxic. No rows give no rows. Other columns are ignored.
    """
    model = char_model(docs, text_col)
    weights, coefficients = learn(docs, labels, model, max_labelled, id_col=id_col, text_col=text_col, label_col=label_col)
    schema = "`doc_id` " + docs.schema[id_col].dataType.simpleString() + ", held_out boolean, score double, predicted int"
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(~in_training(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *(F.struct(F.col(c)).alias(f"keep_{i}") for i, c in enumerate(keep)))
    kept = own.schema.fields[3:]

    def run(batches):
        scorer = Scorer(weights, model, coefficients)
        for batch in pieces(batches):
            scores = np.array([scorer.score(t or "") for t in batch.column(2).to_pylist()], np.float64)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), *(batch.column(3 + i) for i in range(len(kept)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", *(f.name for f in kept)])

    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    out = own.mapInArrow(run, schema)
    return out.select("doc_id", "held_out", "score", "predicted", *(F.col(f"keep_{i}").getField(c).alias(c) for i, c in enumerate(keep)))


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows predicted toxic; columns, whatever their names, stay.

    Null and empty texts have the score of a text without words, and stay unless that is toxic; repeated rows fare alike; a score of just one half is toxic. Without
    labels all rows stay; no rows give none. Labels of ids that docs lacks are not learned from, and null ids have no label.
    """
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    labels = labels.select(F.col("doc_id").alias(at["doc_id"]), "toxic")
    scored = score(renamed, labels, id_col=at["doc_id"], text_col=at["text"], keep=renamed.columns, **options)
    return scored.filter("predicted = 0").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op7_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
