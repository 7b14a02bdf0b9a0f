import random

from xxhash import xxh64_intdigest

from parlance.llm import simhash
from parlance.llm.components import components


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(points, radius):
    root = {p: p for p in points}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in points}


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one two", "É a\x0bb c  d\ne É a b", "word " * 70_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_links_of_dense_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    r = random.Random(4)
    points = set()
    for _ in range(12):
        c = r.getrandbits(64)
        points |= {c, *(c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(30))}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    e = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r.u: r.v for r in components(e).collect()}
    got, want = {}, closure(points, 3)
    for p, s in zip(points, signed, strict=True):
        got.setdefault(found.get(s, s), set()).add(p)
    groups: dict = {}
    for p, t in want.items():
        groups.setdefault(t, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_classes(spark):
    base = " ".join(f"w{i * 7 % 331}" for i in range(900))
    rows = [(10, base), (3, base.upper()), (4, base + " tail"), (5, None), (6, ""), (7, "all else here now"), (7, "all else here now"), (None, "x y")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("10", 3), ("3", 3), ("4", 3), ("5", 5), ("6", 5), ("7", 7), ("7", 7), ("None", None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100)], "u long, v long")
    assert {r.u: r.v for r in components(e).collect()} == {i: 0 for i in range(1, 61)}
