import collections
import hashlib
import random

import numpy as np
import pytest

from parlance.llm import repeats


def brute(docs, n):
    seen = collections.Counter(t[i : i + n] for t in docs for i in range(len(t) - n + 1))
    out = []
    for t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    noise = lambda a, n: "".join(r.choice(a) for _ in range(r.randint(0, n)))
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    out: list = [None, "", None, "ab" * 900, "a" * 1500]
    for _ in range(50):
        a = r.randint(0, 2000)
        out.append(r.choice([noise("abcdefgh é", 900), noise("xyz", 50) + base[a : a + r.randint(0, 900)] + noise("xyz", 50), base[: r.randint(300, 3000)], "a" * r.randint(1, 900), r.choice(out)]))
    return out


def digest(row):
    spans = [(s.low, s.high) for s in row.spans]
    return row.n_bytes, sum(b - a for a, b in spans), len(spans), hashlib.sha256(row.kept).hexdigest()


@pytest.mark.parametrize("n,gram,hot", [(40, 10, 2), (400, 100, 256), (41, 8, 3)])
def test_against_brute_force(spark, n, gram, hot):
    docs = texts(n)
    df = spark.createDataFrame([(i if i != 7 else None, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: digest(r) for r in repeats.remove_repeats(df, n, gram, hot).collect()}
    assert got == {(i if i != 7 else None): w for i, w in enumerate(brute([(t or "").encode() for t in docs], n))}


def test_halves_keep_every_window():
    r = random.Random(4)
    for _ in range(200):
        n, x = 20, r.randint(0, 12)
        y = x + r.randint(1, 20 - x)
        raw = bytes(r.choice(b"ab") for _ in range(r.randint(max(20, y), 20 + x)))  # every window holds x to y
        seen = []
        for first, past, _side, a, b in repeats.halves(raw, x, y, n):
            seen += range(first, past)
            assert all(w <= a and b <= w + n for w in range(first, past)) and (b - a > y - x or y - x == n)
        assert seen == list(range(len(raw) - n + 1))


def test_only_windows_that_can_meet_are_sorted():
    """Runs that share their anchor and less than half of what windows hold besides, of one key, do not reach the transform."""
    r = random.Random(5)
    noise = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    x, n = noise(100), 400
    one, two, both = noise(200) + x + noise(200), noise(200) + x + noise(200), noise(160)
    three, four = noise(40) + both + x + noise(200), noise(40) + both + x + noise(200)  # 160 bytes more to the left
    raws = [one, two, three, four]
    xs = [200] * 4
    kept = repeats.meeting([1] * 4, raws, xs, [300] * 4)
    assert [i for i, _, _ in kept] == [2, 3] and all(0 < past - first < len(three) - n + 1 for _, first, past in kept)
    assert repeats.meeting([1, 1, 2, 3], raws, xs, [300] * 4) == []


def test_windows_that_meet_stay():
    r = random.Random(6)
    n, gram = 20, 5
    for _ in range(60):
        base = bytes(r.choice(b"abc") for _ in range(120))
        texts = [base[(a := r.randint(0, 60)) : a + r.randint(20, 60)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 20))) for _ in range(6)]
        count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        keys, raws = [], []
        for t in texts:
            found = repeats.window_runs(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), n, gram)
            for start, windows, anchor in zip(*(x.tolist() for x in found[1:4]), strict=True):
                keys.append(anchor)
                raws.append(t[start : start + windows + n - 1])
        none = [None] * len(keys)
        stay = {(i, w) for i, first, past in repeats.meeting(keys, raws, none, none, n, gram) for w in range(first, past)}
        assert {(i, w) for i, raw in enumerate(raws) for w in range(len(raw) - n + 1) if count[raw[w : w + n]] > 1} <= stay


@pytest.mark.parametrize("size", [1, 2, 50, 5000, 1 << 21])
def test_suffixes_by_tripling_and_doubling(size):
    symbols = np.random.default_rng(size).integers(1, 3, size)
    depth = 24
    padded = np.concatenate([symbols, np.zeros(depth, np.int64)])
    key = np.zeros(size, np.int64)
    for j in range(depth):
        key = key * 3 + padded[j : j + size]
    order = repeats.suffix_order(symbols, depth)
    assert (np.sort(order) == np.arange(size)).all() and (np.diff(key[order]) >= 0).all()


def test_query(spark):
    out = repeats.op4_repeats(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(docs, brute([t.encode() for t in docs.values()], 400), strict=True))
    for r in out.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert r.n_removed or r.text == docs[r.doc_id]


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    data = ("".join(random.Random(2).choice("ab c") for _ in range(700)) * 3).encode()
    one = repeats.window_runs(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), 40, 10)
    assert sum(one[2]) == len(data) - 39


def test_transform():
    for seed in range(30):
        r = random.Random(seed)
        base = bytes(r.choice(b"ab") for _ in range(60))
        parts = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 9))) + base[(a := r.randint(0, 30)) : a + r.randint(14, 40)] for _ in range(8)]
        n = r.choice([4, 7, 12])
        count = collections.Counter(c[i : i + n] for c in parts for i in range(len(c) - n + 1))
        for c, got in zip(parts, repeats.repeated_windows(parts, n), strict=True):
            assert {i for a, b in got for i in range(a, b)} == {i for i in range(len(c) - n + 1) if count[c[i : i + n]] > 1}


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_different_runs_are_not_taken_for_equal(spark):
    """Two words whose digests differ by a multiple of 2^36, in the Thue-Morse order and its reverse, had one digest as polynomials modulo 2^64."""
    words = "baccmdcl", "mpexpkbv"
    one, two = ("".join(words[(bin(i).count("1") + first) % 2] for i in range(16)) for first in (0, 1))
    end = (
        "jexpbtgalpmaqcvcvxvmalbdtaiuwjxheysjgdnowkmfknuvneoweqkegfolzmnzpmxhzgogswbmbhucflbxuvfhtjtcwqyjylnobuwqvurxnsopiwpgkibbbflajuaecznvhtm"
        "rhogktdtczkkrokiaqbglcgqlg givxxjjqmiplwhbjrcaopxobznpoodcchd yengotc nry mbfhphe ilkndrjtrzgwjyoqtoruiihadtzwdfxnhgjxvaxrqnbdmuidxslhvww"
    )
    docs = spark.createDataFrame([(1, one + end), (2, two + end)], "doc_id long, text string")
    assert len(one + end) == 400
    assert [r.spans for r in repeats.remove_repeats(docs).collect()] == [[], []]


def test_columns_of_the_contract_come_first(spark):
    out = repeats.op4_repeats(spark, "/root/testdata/sf0.001")
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
