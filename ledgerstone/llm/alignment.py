"""Cross-tokenizer alignment of two vocabularies over a corpus, by distinct segments.

A text is cut before those runs of spaces that no token of either vocabulary crosses, which is verified on the vocabularies
themselves. Words repeat, so that a corpus has far fewer distinct segments than occurrences: each distinct one is tokenised by
both and aligned once, into a table. Segments so frequent that they fit a table of bounded size are looked up inside a task;
all others come back to their documents by a join, in which no key is hot any more. Documents are then composed of their
segments: both tokenizers end a token where a segment ends, so that counts add up and groups follow one another.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, pieces, settle, table

TOKENIZERS = "/opt/tokenizers"
FILE_BYTES = 64 << 20  # a vocabulary file may have
FREQUENT, FREQUENT_BYTES = 1 << 19, 80 << 20  # rows and bytes that the table of frequent segments may have
HELD = 600_000  # distinct segments or other pairs that a task counts before it hands them on
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # whatever any engine takes for white space
ALIGNED = "ok boolean, n_a int, n_b int, n_groups int, n_links long, groups string, codes array<long>, times array<int>"  # codes: of linked pairs, a << 32 | b
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def read_vocabularies(path_a: str, path_b: str) -> tuple[bytes, bytes]:
    """Both files, read by the driver: executors get their bytes, which are bounded, and need no copy of the files."""
    for path in (path_a, path_b):
        if os.path.getsize(path) > FILE_BYTES:
            raise ValueError(f"{path} has over {FILE_BYTES} bytes")
    return tuple(open(path, "rb").read() for path in (path_a, path_b))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of each token, and the pattern that texts are cut by."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        said, model = json.loads(a), sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b)
        before, rules = said.get("pre_tokenizer") or {}, model.normalizer_spec
        if said.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError("the first vocabulary has to be a byte-level one that cuts texts into words first and changes nothing")
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the second vocabulary has to be a BPE of pieces that adds a space in front and changes nothing else")
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in said["model"]["vocab"].items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        for x in said.get("added_tokens", ()):
            self.bytes_a[x["id"]] = x["content"].encode()
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("\u2581", " ").encode() for p in model.pieces]
        self.cut = cut_pattern([*self.bytes_a, *self.bytes_b])

        self.sizes = [np.array([len(x) for x in tokens]) for tokens in (self.bytes_a, self.bytes_b)]
        self.some = max(map(len, self.sizes))
        self.spelt = pa.array([f"{i}{after}" for after in (",", "|", ";", "") for i in range(self.some)])

    def align(self, segments: list[str]) -> list[pa.Array]:
        """The columns that ALIGNED names of segments, each without the space that it begins with."""
        ours = [x.ids for x in self.a.encode_batch_fast([f" {s}" for s in segments], add_special_tokens=False)]
        theirs = self.b.encode(segments, num_threads=1)  # it adds the space
        texts = [f" {s}".encode() for s in segments]
        return self.columns(texts, ours, theirs) or [pa.array(c, t) for c, t in zip(zip(*(groups_of(text, x, y, self.bytes_a, self.bytes_b) for text, x, y in zip(texts, ours, theirs))), KINDS.values())]

    def columns(self, texts: list[bytes], ours, theirs):
        """What groups_of() gives of many texts, as columns; None if a text doesn't come back byte for byte: then they have to be looked at one by one."""
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ours, theirs))
        many_a, many_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ours, theirs))
        ends = np.cumsum([len(x) for x in texts])
        size_a, size_b = self.sizes[0][a], self.sizes[1][b]
        end_a, end_b, whole = size_a.cumsum(), size_b.cumsum(), b"".join(texts)
        if not (len(a) and len(b) and many_a.all() and many_b.all() and size_a.all() and size_b.all()):
            return None
        if (end_a[many_a.cumsum() - 1] != ends).any() or (end_b[many_b.cumsum() - 1] != ends).any():
            return None
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b.tolist()]) != whole:
            return None
        group_ends = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b, of = np.searchsorted(group_ends, end_a), np.searchsorted(group_ends, end_b), np.searchsorted(ends, group_ends)
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        x, y, g = crossed(in_a, in_b)
        codes, code = np.unique(a[x] << 32 | b[y], return_inverse=True)
        pairs, times = np.unique(of[g] * len(codes) + code, return_counts=True)
        offsets = lambda owner: pa.array(np.concatenate(([0], np.bincount(owner, minlength=len(texts)).cumsum())), pa.int32())
        held = offsets(pairs // len(codes))
        cells = np.empty(len(a) + len(b), np.int64)  # the numbers in the order in which they are spelt, each with what comes after it
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        cells[np.arange(len(a)) + (in_b.cumsum() - in_b)[of_a]] = a + last_a * self.some
        cells[np.arange(len(b)) + in_a.cumsum()[of_b]] = b + last_b * 2 * self.some + np.isin(end_b, ends) * self.some
        said = self.spelt.take(pa.array(cells))
        begins = np.frombuffer(said.buffers()[1], np.int32)[np.concatenate(([0], (many_a + many_b).cumsum()))]
        groups = pa.StringArray.from_buffers(len(texts), pa.py_buffer(begins.copy()), said.buffers()[2])
        links = np.bincount(of[g], minlength=len(texts))
        numbers = (many_a, many_b, np.bincount(of, minlength=len(texts)), links)
        lists = pa.ListArray.from_arrays(held, pa.array(codes[pairs % len(codes)])), pa.ListArray.from_arrays(held, pa.array(times, pa.int32()))
        return [pa.array(np.ones(len(texts), bool)), *(pa.array(n, t) for n, t in zip(numbers, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))), groups, *lists]


KINDS = {"ok": pa.bool_(), "n_a": pa.int32(), "n_b": pa.int32(), "n_groups": pa.int32(), "n_links": pa.int64(), "groups": pa.string(), "codes": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}


def crossed(in_a: np.ndarray, in_b: np.ndarray):
    """All pairs inside groups of so many of either side: the place of the one, of the other, and the group."""
    links = in_a * in_b
    g = np.repeat(np.arange(len(links)), links)
    i = np.arange(len(g)) - np.repeat(links.cumsum() - links, links)
    return (in_a.cumsum() - in_a)[g] + i // in_b[g], (in_b.cumsum() - in_b)[g] + i % in_b[g], g


def splitter(cut: str):
    """A function from a text to its segments, each without the space that it begins with. A cut depends on the character before a space, and on whether anything comes after it."""
    between, fine = re.compile(cut), {"": False}

    def segments(text: str) -> list[str]:
        said = text.split(" ")
        for c in {s[-1:] for s in said}:
            if c not in fine:
                fine[c] = bool(between.search(f"{c} x"))
            if not fine[c]:
                return [s[1:] for s in between.split(f" {text}")]
        return said

    return segments


def cut_pattern(tokens) -> str:
    """Where texts are cut: before a space with something after it, and before it a character that's neither blank nor before a space in any token.

    The words that the first vocabulary cuts texts into end before blanks, and merges go on inside a word only; the second has no token that goes
    on from such a character to a space, so that none of its merges can. A space that ends the text stays: alone it would be an empty text.
    """
    crossed = {t[:i].decode("utf-8", "replace")[-1] for t in tokens for i in range(1, len(t)) if t[i] == 0x20}
    if "\ufffd" in crossed:
        raise ValueError("a token has a space inside a character")
    own = "".join(sorted(f"\\U{ord(c):08x}" for c in crossed))
    return f"(?<=[^{BLANKS}{own}])(?= (?s:.))"


def groups_of(whole: bytes, ids_a, ids_b, bytes_a, bytes_b):
    """What ALIGNED names of one segment: a group ends where tokens of both end."""
    x, y = [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
    if b"".join(x) != whole or b"".join(y) != whole:
        return False, 0, 0, 0, 0, "", [], []
    said, codes, i, j = [], [], 0, 0
    while i < len(x):
        first_a, first_b, ahead = i, j, len(x[i]) - len(y[j])
        i, j = i + 1, j + 1
        while ahead:
            if ahead < 0:
                ahead += len(x[i])
                i += 1
            else:
                ahead -= len(y[j])
                j += 1
        a, b = ids_a[first_a:i], ids_b[first_b:j]
        codes += [p << 32 | q for p in a for q in b]
        said.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
    links, times = len(codes), [1] * len(codes)
    if len(codes) > 1 and len(set(codes)) < len(codes):
        codes, times = map(list, zip(*Counter(codes).items()))
    return True, len(ids_a), len(ids_b), len(said), links, ";".join(said), codes, times


def segment_counts(docs: DataFrame, cut: str) -> DataFrame:
    """seg, n: how often each distinct segment stands in the texts. cut: the pattern between segments."""

    def count(batches):
        segments, held = splitter(cut), Counter()

        def rows():
            out = pa.record_batch({"seg": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for part in pieces(batches, 200):
            for text in part["text"].to_pylist():
                if text:
                    held.update(segments(text))
            if len(held) > HELD:
                yield rows()
        if held:
            yield rows()

    counted = docs.select("text").mapInArrow(count, "seg string, n long")
    return counted.repartition(partitions(docs), "seg").groupBy("seg").agg(F.sum("n").alias("n"))


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dictionary(docs: DataFrame, files, cut: str) -> DataFrame:
    """sid, seg, n and what ALIGNED names, one row a distinct segment, materialised."""

    def tokenise(batches):
        vocabularies = Vocabularies(*files)
        for part in pieces(batches, 500):
            yield pa.record_batch([part["seg"], part["n"], *vocabularies.align(part["seg"].to_pylist())], names=["seg", "n", *KINDS])

    return materialise(segment_counts(docs, cut).mapInArrow(tokenise, f"seg string, n long, {ALIGNED}").withColumn("sid", F.monotonically_increasing_id()), "align-segments", "zstd")


def frequent_from(segments: DataFrame, most=FREQUENT, most_bytes=FREQUENT_BYTES) -> int:
    """The least power of the fourth root of two such that the segments with that many occurrences keep to both bounds."""
    level = F.floor(F.log2("n") * 4).cast("int")
    weight = F.octet_length("seg") + F.octet_length("groups") + 8 * F.size("codes")
    rows = segments.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(weight).alias("bytes")).collect()  # 4 levels for each bit of a count at most
    left, room, least = most, most_bytes, 1 << 10
    for r in sorted(rows, key=lambda r: -r["level"]):
        left, room = left - r["rows"], room - r["bytes"]
        if left < 0 or room < 0:
            break
        least = r["level"]
    return least


ESCAPE = 0xFFFF


def packed(ids: np.ndarray) -> bytes:
    """Numbers from -1 to 2^32 - 3, two bytes each if small: others are an escape and the number plus one in four bytes."""
    small = (ids >= 0) & (ids < ESCAPE)
    begin = np.cumsum(np.where(small, 1, 3)) - np.where(small, 1, 3)
    out = np.zeros(int(np.where(small, 1, 3).sum()), np.uint16)
    out[begin[small]] = ids[small]
    large = begin[~small]
    out[large], out[large + 1], out[large + 2] = ESCAPE, (ids[~small] + 1) & 0xFFFF, (ids[~small] + 1) >> 16
    return out.tobytes()


def unpacked(cell: bytes | None) -> np.ndarray:
    """What packed() was given; null: nothing. Both halves of a large number are less than the escape, or stand where none can begin."""
    if cell is None:
        return np.zeros(0, np.int64)
    x = np.frombuffer(cell, np.uint16).astype(np.int64)
    marks = np.flatnonzero(x == ESCAPE)
    if not len(marks):
        return x
    begin, last = [], -1
    for m in marks.tolist():  # a half may look like the escape
        if m > last:
            begin.append(m)
            last = m + 2
    begin = np.array(begin)
    x[begin] = x[begin + 1] + (x[begin + 2] << 16) - 1
    keep = np.ones(len(x), bool)
    keep[begin + 1] = keep[begin + 2] = False
    return x[keep]


def encoded(docs: DataFrame, cut: str, frequent) -> DataFrame:
    """rid, doc_id, ids (of frequent segments, in order, -1 for the others, packed), rare (the others), materialised. Texts without tokens have null ids.

    frequent: a broadcast list of segments, the most frequent first, since small numbers take least room.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        segments, number = splitter(cut), {s: i for i, s in enumerate(frequent.value)}
        for part in pieces(batches, 200):
            ids, rare = [], []
            for text in part["text"].to_pylist():
                if not text:
                    ids.append(None)
                    rare.append(None)
                    continue
                said = segments(text)
                own = np.array([number.get(s, -1) for s in said], np.int64)
                ids.append(packed(own))
                rare.append([said[i] for i in np.flatnonzero(own < 0).tolist()] or None)
            yield pa.record_batch([part["doc_id"], pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.string()))], names=["doc_id", "ids", "rare"])

    return materialise(docs.mapInArrow(encode, f"doc_id {kind}, ids binary, rare array<string>").withColumn("rid", F.monotonically_increasing_id()), "align-encoded", "zstd")


SPACES = str.maketrans(",|;", "   ")


def codes_of(groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of groups as they are spelt, and which of the list each is of."""
    if not groups:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = ";".join(groups)
    ids, marks = np.fromstring(whole.translate(SPACES), np.int64, sep=" "), np.frombuffer(whole.encode(), np.uint8)
    marks = marks[(marks < 48) | (marks > 57)]
    group = np.concatenate(([0], (marks == 59).cumsum()))
    second = np.concatenate(([0], (marks == 124).cumsum())) > group
    x, y, g = crossed(np.bincount(group[~second]), np.bincount(group[second]))
    return ids[~second][x] << 32 | ids[second][y], np.repeat(np.arange(len(groups)), [s.count(";") + 1 for s in groups])[g]


def composed(texts: DataFrame, frequent) -> DataFrame:
    """Two kinds of rows. Of each text: rid, ok (whether it has tokens), groups_sha256, sids (of its other segments). Of each task's linked pairs: code, documents (how many texts hold it).

    texts: rid, ids, rare (sid and groups of the other segments, in order, null groups if a segment doesn't come back byte for byte).
    frequent: a broadcast (ok, groups, begin, place, codes), the pairs of segment i being codes[place[begin[i]:begin[i + 1]]], codes sorted.
    """

    def compose(batches):
        ok, said, begin, place, codes = frequent.value
        size, times, held, n = np.diff(begin), np.zeros(len(codes), np.int64), [], 0

        def rows(**cells):
            kinds = {"rid": pa.int64(), "ok": pa.bool_(), "groups_sha256": pa.string(), "sids": pa.list_(pa.int64()), "code": pa.int64(), "documents": pa.int64()}
            some = len(next(iter(cells.values())))
            return pa.record_batch([cells.get(k, pa.nulls(some, t)) for k, t in kinds.items()], names=list(kinds))

        def others():
            code, many = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return rows(code=pa.array(code), documents=pa.array(many))

        for part in pieces(batches, 200):
            fine, digests, met, more = [], [], [], []
            rare = part["rare"].fill_null([])
            inside, ends = rare.flatten(), pc.list_value_length(rare).to_numpy().cumsum().tolist()
            spelt, at = inside.field("groups").to_pylist(), 0
            for cell, end in zip(part["ids"].to_pylist(), ends):
                ids, mine, at = unpacked(cell), spelt[at:end], end
                fine.append(len(ids) > 0 and bool(ok[ids].all()) and None not in mine)
                digests.append("")
                if not fine[-1]:
                    continue
                rest = iter(mine)
                digests[-1] = hashlib.sha256(";".join([said[i] if i >= 0 else next(rest) for i in ids.tolist()]).encode()).hexdigest()
                own = ids[ids >= 0]
                many = size[own]
                met.append((place[np.repeat(begin[own] - many.cumsum() + many, many) + np.arange(many.sum())], len(more)))
                more += mine
            code, of = codes_of(more)
            k = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            there = codes[k] == code if len(codes) else np.zeros(len(code), bool)
            bounds = np.array([first for _, first in met], np.int64)
            text = np.searchsorted(bounds, of, "right")  # of texts without such segments none is found, whichever has the same bound
            known, edges = k[there], np.searchsorted(text[there], np.arange(len(met) + 2))
            for i, (found, _) in enumerate(met, 1):
                times[np.concatenate((found, known[edges[i] : edges[i + 1]]))] += 1  # once for a text, however often a pair is in it
            if not there.all():
                new, inverse = np.unique(code[~there], return_inverse=True)
                held.append(new[np.unique(text[~there] * len(new) + inverse) % len(new)])
                n += len(held[-1])
            offsets = pa.array([0, *ends], pa.int32())
            yield rows(rid=part["rid"], ok=pa.array(fine, pa.bool_()), groups_sha256=pa.array(digests, pa.string()), sids=pa.ListArray.from_arrays(offsets, inside.field("sid")))
            if n > HELD:
                yield others()
                n = 0
        if held:
            yield others()
        some = np.flatnonzero(times)
        yield rows(code=pa.array(codes[some]), documents=pa.array(times[some]))

    return texts.mapInArrow(compose, "rid long, ok boolean, groups_sha256 string, sids array<long>, code long, documents long")


def composed_with_rare(texts: DataFrame, others: DataFrame, told, parts: int) -> DataFrame:
    """What composed() gives of all texts, materialised: other segments come back to their texts by a join. A function of its own, so that nothing holds its shuffles when it is done."""
    places = texts.filter(F.col("rare").isNotNull()).select("rid", F.posexplode("rare").alias("pos", "seg"))
    rare = places.join(others.select("seg", "sid", F.when(F.col("ok"), F.col("groups")).alias("groups")), "seg").drop("seg")
    rare = rare.repartition(parts, "rid")  # as rows: lists put together before the shuffle would be longer
    inside = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sid", "groups"))), lambda x: F.struct(x["sid"].alias("sid"), x["groups"].alias("groups")))
    met = texts.select("rid", "ids").join(rare.groupBy("rid").agg(inside.alias("rare")), "rid", "left")
    return materialise(composed(met, told), "align-composed", "zstd")


def frequent_counts(texts: DataFrame, frequent) -> DataFrame:
    """rid, doc_id and COUNTS over the frequent segments of each text. frequent: a broadcast matrix, a row a segment and one of zeros."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def count(batches):
        counts = frequent.value
        for part in pieces(batches, 1000):
            cells = np.array([counts[unpacked(x)].sum(0) for x in part["ids"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([part["rid"], part["doc_id"], *(pa.array(cells[:, i]) for i in range(len(COUNTS)))], names=["rid", "doc_id", *COUNTS])

    return texts.select("rid", "doc_id", "ids").mapInArrow(count, f"rid long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}")


def align(docs: DataFrame, path_a: str, path_b: str, most=FREQUENT, most_bytes=FREQUENT_BYTES, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first vocabulary encodes a space and the text, the second the text, before which it puts a space itself; strings of special tokens are plain text.
    Null and empty texts, texts that aren't UTF-8, and those that either vocabulary doesn't give back byte for byte have zeros and '' and count nowhere.
    Repeated rows count each on its own, null ids are kept, no rows give none. Texts are read whole, of whatever length, and a text without a place to
    cut is one segment. Only the id and text columns are read; others, whatever their names, are ignored. most, most_bytes: bounds of the table of frequent segments,
    which decide where a segment is looked up, not what comes out. An id of the first vocabulary has at most as many pairs as the second has tokens.
    """
    files = read_vocabularies(path_a, path_b)
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(F.is_valid_utf8(text), text).alias("text"))
    cut = Vocabularies(*files).cut
    segments = dictionary(own, files, cut)
    settle(spark)
    least = frequent_from(segments, most, most_bytes)
    often = F.floor(F.log2("n") * 4).cast("int") >= least
    known = segments.filter(often).select("sid", "seg", "n", "ok", *COUNTS[:4], "groups", "codes").toArrow().sort_by([("n", "descending"), ("seg", "ascending")])  # at most `most` rows of most_bytes
    ok = np.array([*known["ok"].to_pylist(), True], bool)  # the last stands for those that aren't frequent
    codes, place = np.unique(known["codes"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(pc.list_value_length(known["codes"]).to_numpy()))).astype(np.int64)
    texts = encoded(own, cut, spark.sparkContext.broadcast(known["seg"].to_pylist()))

    told = spark.sparkContext.broadcast((ok, known["groups"].to_pylist(), begin, place.astype(np.int32), codes))
    found = composed_with_rare(texts, segments.filter(~often), told, partitions(docs))
    told.unpersist()
    settle(spark)

    counted = found.filter(F.col("code").isNotNull()).groupBy("code").agg(F.sum("documents").alias("documents"))
    ranked = counted.withColumn("most", F.max("documents").over(Window.partitionBy(F.shiftright("code", 32))))
    links = segments.select("sid", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("sid", F.col("p.codes").alias("code"), F.col("p.times").alias("m")).join(ranked, "code")
    best = F.sum(F.when(F.col("documents") == F.col("most"), F.col("m")).otherwise(0)).cast("long").alias("n_best")
    scores = links.groupBy("sid").agg(best, F.sum(F.col("m") * F.col("documents")).cast("long").alias("count_sum"))
    scores = materialise(segments.select("sid", "n", *COUNTS[:4]).join(scores, "sid", "left").fillna(0, ["n_best", "count_sum"]), "align-scores", "zstd")
    drop(segments)
    scored = scores.filter(often).select("sid", *COUNTS).toArrow().sort_by("sid")  # as many rows as known
    counts = np.column_stack([scored[c].to_numpy() for c in COUNTS]).astype(np.int64)[pc.index_in(known["sid"], scored["sid"].combine_chunks()).to_numpy()]
    counts = np.vstack([counts, np.zeros((1, len(COUNTS)), np.int64)])
    out = frequent_counts(texts, spark.sparkContext.broadcast(counts)).join(found.filter(F.col("rid").isNotNull()).select("rid", "ok", "groups_sha256"), "rid")
    more = found.select("rid", F.explode("sids").alias("sid")).join(scores.filter(~often).drop("n"), "sid").groupBy("rid").agg(*(F.sum(c).alias(f"more_{c}") for c in COUNTS))
    both = lambda c: F.when(F.col("ok"), F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias(c)
    return out.join(more, "rid", "left").select("doc_id", *(both(c) for c in COUNTS), "groups_sha256")


def op12_alignment(spark, sf_dir, tokenizers=TOKENIZERS):
    return align(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
