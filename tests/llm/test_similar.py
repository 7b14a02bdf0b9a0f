import random
from collections import defaultdict

from parlance.llm import similar


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def classes(rows, similarity=0.8):
    """doc_id to the smallest doc_id of its class, by comparing every two different sets that share a shingle."""
    sets, root, where = defaultdict(list), {}, defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for n, s in enumerate(keys):
        root[n] = n
        seen = defaultdict(int)
        for g in s:
            for m in where[g]:
                seen[m] += 1
            where[g].append(n)
        for m, shared in seen.items():
            if shared / (len(s) + len(keys[m]) - shared) >= similarity:
                a, b = top(n), top(m)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for n, s in enumerate(keys):
        low[top(n)] += sets[s]
    return {i: min(ids) for ids in low.values() for i in ids}


def varied(r, words, changes):
    words = list(words)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{r.getrandbits(40)}"
    return " ".join(words)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(60):  # similarities on both sides of 0.8
        base = [f"w{r.getrandbits(30)}" for _ in range(r.randint(60, 400))]
        for c in (0, len(base) // 80, len(base) // 60, len(base) // 25, len(base) // 12):
            rows.append((n := n + 1, varied(r, base, c)))
    hot = [f"h{r.getrandbits(30)}" for _ in range(300)]
    rows += [(n + 1 + i, varied(r, hot, 3)) for i in range(700)]  # one group above the size of a shard, all different
    monkeypatch.setattr(similar, "SHARD", 64)
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_unlike_texts_of_one_shard(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARD", 4)
    monkeypatch.setattr(similar, "band_keys", lambda nodes: nodes.selectExpr("7L as key", "fp"))
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.getrandbits(30)}" for _ in range(50))) for i in range(60)]
    rows += [(100 + i, t + " tail") for i, t in rows]
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_rows_at_the_edges(spark):
    base = " ".join(f"w{i * 7 % 331}" for i in range(900))
    rows = [(10, base), (3, base.upper()), (4, base + " tail"), (5, None), (6, ""), (7, "all else here now"), (7, "all else here now"), (None, "x y"), (8, "word " * 70_000)]
    kept = similar.keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")).collect()
    assert sorted((str(r.doc_id), r.n) for r in kept) == [("3", 1), ("5", 1), ("7", 1), ("8", 1), ("None", 1)]
    assert similar.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_star_of_thousands(spark):
    r = random.Random(5)
    base = [f"s{r.getrandbits(30)}" for _ in range(400)]
    rows = [(i, varied(r, base, 6)) for i in range(2000)] + [(2000, " ".join(base))]  # at least 0.85 to the last, about 0.74 to each other
    center = shingles(rows[-1][1])
    assert all(len(center & s) / len(center | s) >= 0.8 for s in (shingles(t) for _, t in rows))
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(2001), 0)


def test_a_line_that_repeats_joins_nothing(spark):
    r = random.Random(6)
    line = [f"l{i}" for i in range(7)]
    rows = [(i, " ".join(line * 60 + [f"w{r.getrandbits(30)}" for _ in range(200)])) for i in range(20)]
    assert len({similar.majority(similar.shingle_hashes(t, 5)) for _, t in rows}) == 1
    rows += [(100 + i, t + " tail") for i, t in rows] + [(200, " ".join([*line * 30, *rows[3][1].split()])), (201, rows[4][1].replace(" ".join(line * 59) + " ", "", 1))]
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)
    assert len(set(got.values())) == 20
