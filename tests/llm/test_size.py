"""What work at size rests on."""

import numpy as np

from ledgerstone.llm import ann


def test_vectors_travel_by_the_block(spark):
    """Up to blocks^2 rows, not one for each vector and block that asks for it."""
    ids = np.array([b << ann.ROW_BITS | r for b in range(3) for r in range(200)])
    points = spark.createDataFrame([(int(i), np.array([i % 7, i >> 33, 1], np.float32).tobytes()) for i in ids], "id long, x binary")
    graph = spark.createDataFrame([(int(i), [1.0, float(i % 5)] if i % 2 else [1.0]) for i in ids], "id long, sims array<float>")
    wanted = {0: ids[::3], 1: ids[5:450], 2: ids[:1]}
    asks = spark.createDataFrame([(k, v.tolist()) for k, v in wanted.items()], "asker int, ids array<long>")
    rows = ann.fetched(asks, ann.stocked(points, 3).unionByName(ann.lowest(graph, 3, 2)), 3).collect()
    assert len(rows) == 3 + 3 + 1
    for asker, own in wanted.items():
        got, x, worst = ann.received([(np.array(r["ids"]), bytes(r["x"]), np.array(r["worst"])) for r in rows if r["asker"] == asker])
        assert (got == own).all() and (x == np.column_stack([own % 7, own >> 33, np.ones(len(own))])).all()
        assert (worst == np.where(own % 2, own % 5, -np.inf)).all()


def test_top_by_one_key_is_top_by_three():
    rng = np.random.default_rng(3)
    for wide in (0, 40):  # ids too large for one key are sorted by three
        o, i = (rng.integers(0, 3, 5000) << 33 | rng.integers(0, 20, 5000) for _ in range(2))
        i = i + (1 << wide if wide else 0) * (i % 2)
        s, f = ((i * 31 + o) % 97 / 97 - 0.5).astype(np.float32), rng.integers(-1, 2, 5000).astype(np.int8)
        want = {}
        for a, b, c, d in zip(o.tolist(), i.tolist(), s.tolist(), f.tolist()):
            want.setdefault(a, {})[b] = (-c, b, min(d, want.get(a, {}).get(b, (0, 0, 9))[2]))
        want = [(a, b, -c, d) for a in sorted(want) for c, b, d in sorted(want[a].values())[:7]]
        assert list(zip(*(x.tolist() for x in ann.top(o, i, s, f, 7)))) == want


def test_frequent_segments_have_small_numbers(spark, monkeypatch):
    """Two bytes a place for the commonest 65,535 instead of six for whatever stands late in a table."""
    from ledgerstone.llm import alignment

    seen, real = [], alignment.encoded
    monkeypatch.setattr(alignment, "encoded", lambda docs, cut, frequent: seen.append(frequent.value) or real(docs, cut, frequent))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[i:], "the"] * 40)) for i in range(40)], "doc_id long, text string")
    paths = [f"{alignment.TOKENIZERS}/{x}" for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert alignment.align(docs, *paths).filter("n_a > 0").count() == 40
    assert seen[0][0] in ("the", "w39") and seen[0][1:] == [w for w in ("the", "w39", *words[38::-1]) if w != seen[0][0]][: len(seen[0]) - 1]


def test_many_segments_align_as_each_alone():
    from ledgerstone.llm import alignment

    v = alignment.Vocabularies(*alignment.read_vocabularies(*(f"{alignment.TOKENIZERS}/{x}" for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))))
    odd = ["a", "", "the", "naïve", "x" * 70, "你好　世", "  b", "\n\n", "ababab,abab", "1234567", "\U0001f468‍\U0001f469"]
    for texts in (odd, [*odd, "▁"]):  # a mark that doesn't come back: all are looked at one by one
        want = [alignment.groups_of(f" {t}".encode(), v.a.encode(f" {t}", add_special_tokens=False).ids, v.b.encode(t), v.bytes_a, v.bytes_b) for t in texts]
        got = list(zip(*(c.to_pylist() for c in v.align(texts))))
        assert [(*g[:6], dict(zip(*g[6:]))) for g in got] == [(*w[:6], dict(zip(*w[6:]))) for w in want]
    code, of = alignment.codes_of(["5,6|7;8|9", "1|2,3"])
    assert code.tolist() == [5 << 32 | 7, 6 << 32 | 7, 8 << 32 | 9, 1 << 32 | 2, 1 << 32 | 3] and of.tolist() == [0, 0, 0, 1, 1]
