"""Cross-tokenizer alignment, against both tokenizers over whole texts."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from ledgerstone.llm import alignment

PATHS = tuple(f"{alignment.TOKENIZERS}/{x}" for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "  ", "\n", "a", "a b", "a  b", "a   b ", " a b", "the cat sat on the mat", "the cat sat on the mat", "\tone\n  two \n three", "it's  what's  left   of　 it  all", "▁ x", "a▁ b",
    "x ᠎ y\x1c z\x85 w", "<|endoftext|> and <s> and </s> <unk> <0x41>", "naïve café é ﬁne", "你好 世界", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok", "nul\x00 byte \x00", "x" * 3000, " ".join(["word"] * 2000) + " end.",
    "1234567 89 3.14 -- ... !!! ?!", "def f(x):\n    return x ** 2\n\n\n", "the the the, the. The THE", "a" + " " * 50 + "b", "ends with blanks   ", "ends with one ",
]


def brute(texts):
    v = alignment.Vocabularies(*alignment.read_vocabularies(*PATHS))
    found = []
    for t in texts:
        t = t or ""
        whole = f" {t}".encode()
        a, b = v.a.encode(f" {t}", add_special_tokens=False).ids, v.b.encode(t)
        if not t or b"".join(v.bytes_a[i] for i in a) != whole or b"".join(v.bytes_b[i] for i in b) != whole:
            found.append(None)
            continue
        place = {}
        for side, ids, of in ((0, a, v.bytes_a), (1, b, v.bytes_b)):
            end = 0
            for i in ids:
                end += len(of[i])
                place.setdefault(end, [0, 0])[side] = 1
        ends = sorted(e for e, both in place.items() if both == [1, 1])
        groups = []
        for side, ids, of in ((0, a, v.bytes_a), (1, b, v.bytes_b)):
            end, k = 0, 0
            for i in ids:
                end += len(of[i])
                while end > ends[k]:
                    k += 1
                while len(groups) <= k:
                    groups.append(([], []))
                groups[k][side].append(i)
        found.append((len(a), len(b), groups))
    held = Counter(p for f in found if f for p in {(x, y) for a, b in f[2] for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in f[2] for x in a for y in b]
        spelt = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in f[2])
        out.append((f[0], f[1], len(f[2]), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "most_bytes"), [(1 << 17, 1 << 25), (30, 1 << 25), (0, 0), (1 << 17, 900)])
def test_any_split_into_frequent_and_rare_segments_is_exact(spark, most, most_bytes):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, `a.b` string")
    got = {r["doc_id"]: tuple(r[c] for c in (*alignment.COUNTS, "groups_sha256")) for r in alignment.align(docs, *PATHS, most, most_bytes).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)
    assert got[14] == got[0] == (0, 0, 0, 0, 0, 0, "")  # a mark that the second vocabulary reads as a space


def test_query_matches_both_tokenizers_over_whole_texts(spark, tmp_path):
    from helpers import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), brute([r["text"] for r in rows])))
    got = {r["doc_id"]: tuple(r[c] for c in (*alignment.COUNTS, "groups_sha256")) for r in alignment.op12_alignment(spark, DATA).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 10_000


def test_repeats_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.align(docs, *PATHS).collect())
    assert got == [(0, 2, 6), (3, 0, 0), (3, 2, 6), (3, 2, 6)]
    assert alignment.align(docs.limit(0), *PATHS).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert [tuple(r)[1:] for r in alignment.align(odd, *PATHS).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_cuts_are_where_no_token_crosses():
    v = alignment.Vocabularies(*alignment.read_vocabularies(*PATHS))
    assert re.split(v.cut, " a b  c  d ") == [" a", " b", "  c", "  d "]
    assert re.compile(alignment.cut_pattern([b"x y"])).split(" x y z") == [" x y", " z"]  # a token that goes on after x


def test_packed_numbers_come_back():
    import numpy as np

    odd = np.array([-1, 0, 1, 65533, 65534, 65535, 65536, 131069, 131070, 131071, 65534 << 16, (65535 << 16) - 2, 2**32 - 3, -1, -1, 7])
    for ids in (odd, odd[::-1], odd[:0], np.random.default_rng(1).integers(-1, 1 << 19, 5000)):
        assert (alignment.unpacked(alignment.packed(ids)) == ids).all()
    assert len(alignment.unpacked(None)) == 0
