"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import negatives


def brute(rows, anchors, n_pos=5, n_neg=5, least=80):
    """rows: (vec_id, label, ints)."""
    out = set()
    for a, al, av in rows:
        if a not in anchors:
            continue
        met = [(sum(x * y for x, y in zip(av, v, strict=True)), i, lb) for i, lb, v in rows if i != a and len(v) == len(av)]
        first = sorted(((-s, i) for s, i, lb in met if lb == al))[:n_pos]
        for s, p in first:
            ok = sorted((-t, i) for t, i, lb in met if lb != al and least * -s <= 100 * t <= 100 * -s)[:n_neg]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(ok, 1)}
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.fixture
def small(monkeypatch):
    """Blocks and pivots so small that a search needs many."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PER_PIVOT", 40)
    monkeypatch.setattr(negatives, "ASKING", 3)


def test_against_brute_force_with_ties_and_clusters(spark, small):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5))
    x = np.round(centres[rng.integers(0, 6, 600)] * 2 + rng.normal(size=(600, 5)) * 0.3, 1)
    x[:120] = x[0]  # equal vectors of several labels
    labels = rng.integers(0, 4, 600)
    labels[5] = 99  # alone with its label
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(range(600), x, labels, strict=True)]
    whole = [(i, k, [int(np.floor(256 * c)) for c in v]) for i, v, k in rows]
    df = frame(spark, rows).withColumns({"q": F.lit(0), "rank": F.lit("x"), "block": F.lit(1)})
    assert got(negatives.mine(df, F.col("vec_id") % 30 == 5)) == brute(whole, {i for i in range(600) if i % 30 == 5})


def test_certified_by_few_blocks_where_there_is_structure(spark, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 10
    x = centres[np.arange(2000) % 20] + rng.normal(size=(2000, 8)) * 0.01
    rows = frame(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)]).withColumn("asked", F.col("vec_id") == 7)
    found = negatives.classes(negatives.integers(rows), 5)
    longest = float(np.sqrt((np.floor(256 * x) ** 2).sum(axis=1).max())) * (1 + 1e-12)
    pivots = negatives.fit(found, 2000, longest)
    blocks, directory = negatives.index(found, pivots, longest)
    asked = negatives.placed(found.where("cid = 7").select(F.col("cid").alias("q"), "label", "v"), pivots, longest)
    none = F.array(F.lit(None).cast("bigint"))
    same = np.floor(256 * x[1::3])
    reach = negatives.radius_of(F.col("square"), F.lit(float(np.sort(same @ same[2])[-6])), longest)  # of the sixth best of label 1
    met = negatives.visits(asked.withColumns({"caps": none, "floors": none, "reach": reach, "seen": F.lit(None).cast("double")}), directory, True, longest).count()
    assert 0 < met < 0.5 * blocks.count()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0], 1), (8, [0.9, 0.5], None), (9, [0.0, 0.0], 2), (None, [1.0, 1.0], 2), (100, [-1.0, -1.0], 3), (101, [1.0, 1.0], 3), (200, [], 4), (201, [], 4), (202, [], 5), (300, [0.001, -0.001], 6)]
    out = got(negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert out == [(0, 1, 1, 2, 256 * 256 + 128 * 128, 230 * 256 + 128 * 128)] * 2 + [(200, 201, 1, 202, 0, 0)]
    assert negatives.mine(frame(spark, rows).limit(0), F.lit(True)).isEmpty() and negatives.mine(frame(spark, rows), F.lit(None).cast("boolean")).isEmpty()


def test_numbers_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**21, 2.0]])
    assert negatives.products(a, b).tolist() == [[2**60 + 3, 2**61 + 6]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**60]]), np.array([[2.0**10]]))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in table]
    assert got(negatives.op13_negatives(spark, d)) == brute(rows, {r[0] for r in rows if r[0] % 100 == 0})
