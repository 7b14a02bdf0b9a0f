import random
import zlib
from collections import Counter

import numpy as np
import pytest

from parlance.llm import packing as P

ODD = ["a\x1cb\x85c d ² Ⅷ ５ naïve 日本語 é <|endoftext|> it's  \n\n x​", "", "   ", "s it's I'll 're'rex' ''s  's don'tx 'd\n's", "\n\n  a\t b \r\n", "'", "a\0b", "x" * 3000, "ab " * 5000]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    from tokenizers import Tokenizer

    m = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    m.encode_special_tokens = True
    return m


def test_ids_are_those_of_tokenizers(model, spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    e = P.Encoder(*P.vocabulary())
    want = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.ids(texts)] == want
    assert e.long(" ".join(texts)).tolist() == model.encode(" ".join(texts), add_special_tokens=False).ids


def test_long_texts_and_a_full_table(model, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 500)
    monkeypatch.setattr(P, "MEMORY", 2000)
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 500)}" for _ in range(900)) + "\n" for _ in range(5)]
    e = P.Encoder(*P.vocabulary())
    assert [x.tolist() for x in e.ids(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_one_hash(model):
    """Thue and Morse's words: polynomial hashes modulo 2^64 of these two are equal whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    want = [x.ids for x in model.encode_batch([one, two, f"x {two} {one} y"], add_special_tokens=False)]
    for order in ([0, 1, 2], [2, 1, 0]):
        e = P.Encoder(*P.vocabulary())
        texts = [one, two, f"x {two} {one} y"]
        assert [x.tolist() for x in e.ids([texts[i] for i in order])] == [want[i] for i in order]
        assert [e.ids([texts[i]])[0].tolist() for i in order for _ in range(2)] == [want[i] for i in order for _ in range(2)]


def test_plans():
    for seed in range(150):
        r = random.Random(seed)
        want = Counter(r.choice([r.randint(1, 90), r.randint(300, 400), r.randint(1, 1024), 512, 342]) for _ in range(r.randint(0, 400)))
        got: Counter = Counter()
        bins = 0
        for n, items in P.plan(dict(want)):
            assert n > 0 and sum(a * k for a, k in items) <= 1024 and sum(k for a, k in items if 3 * a > 1024) <= 2
            bins += n
            for a, k in items:
                got[a] += n * k
        assert got == want
        full = -(-sum(a * k for a, k in want.items()) // 1024)
        assert bins <= max(full, sum(k for a, k in want.items() if a > 512)) * 1.25 + 1


def test_query_shape(spark, model):
    rows = [(1, "hello world " * 900), (2, None), (2, None), (3, ""), (4, "x"), (4, "x")]
    pieces = P.tokenize(spark.createDataFrame(rows, "doc_id long, text string"), *P.vocabulary()).cache()
    out = P.pack(pieces).collect()
    ids = np.array([*model.encode(rows[0][1], add_special_tokens=False).ids, 2], "<u4")
    first = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in first] == P.cuts(len(ids), 1024)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in first)
    assert len(out) == len(first) + 5
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack(P.tokenize(spark.createDataFrame([], "doc_id long, text string"), *P.vocabulary())).isEmpty()


def test_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    m = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = ["a<|endoftext|>b", mark, f"{mark}{mark} x", f"it's  {mark}  {mark}\n end {mark}", "none <|endoftext| >", *ODD]
    pieces = P.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *P.vocabulary(), capacity=100_000, keep_ids=True)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.collect()}
    assert got == {i: [*m.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_offsets_of_salts(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)
    rows = [(n, s, (n * 7 + s * 5) % 4 + 1) for n in (1, 2) for s in range(40) if (n + s) % 5]
    got = {(r.b_length, r.b_salt): r.before for r in P.offsets(spark.createDataFrame(rows, "length long, salt long, n long"), 40).collect()}
    assert got == {(n, s): sum(k for m, t, k in rows if m == n and t < s) for n, s, _ in rows}


def test_equal_rows_have_their_own_places(spark):
    pieces = spark.createDataFrame([(1, 0, 300)] * 2000 + [(None, 0, 7)] * 500, "doc_id long, piece int, length long")
    out = P.pack(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 2500 == len(out)
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 1024 for v in used.values())
