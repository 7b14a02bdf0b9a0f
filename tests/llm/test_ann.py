import numpy as np
from pyspark.sql import functions as F

from parlance.llm import ann


def test_curve_is_continuous():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert(cells, 3)
    assert len(set(keys)) == 512 and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    ids, x = (np.array(c) for c in zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True))
    got: dict = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x[q].astype(float) @ x.T.astype(float)
        s[q] = -np.inf
        near = sorted(got[ids[q]])
        assert [n for n, _, _ in near] == list(range(1, 21))
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & {v for _, v, _ in near})
    assert hit >= 0.9 * 20 * len(got)


def test_edges_are_exact_when_small(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [3.0, 0.0]), (8, [-1.0, 0.5]), (40, []), (60, [1.0, 2.0, 3.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 7, 3.0), (2, 1, 1.0), (3, 20, 1.0)], 20: [(1, 7, 3.0), (2, 0, 1.0), (3, 1, 1.0)]}
    assert ann.search(df.limit(0), F.lit(True)).isEmpty()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.0, float(i * 7919 % 400), 1.0]) for i in range(1, 400)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in out] == [(i, i, 0.0) for i in range(1, 21)]


def test_scores_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 24)), 3)
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, cid int")
    fold = lambda a, b: float(np.cumsum(a * b)[-1])
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5).collect():
        assert r.score == fold(x[r.query_id], x[r.vec_id])


def test_structure_needs_short_windows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(20_000, 3)), np.zeros((20_000, 29))], axis=1) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    points = spark.createDataFrame([(i, v.tolist(), i % 100 == 0) for i, v in enumerate(x)], "cid long, v array<double>, queried boolean").cache()
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    ranked = ann._ranked(ann._keyed(points, longest, 8, 1)).cache()
    assert ann.fitted_window(points, ranked, 10, 64, 0.9) < 1000


def test_lengths_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0]), (3, [4.0])], "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 1, 4.0), (20, 1, 3, 4.0)]
    assert ann.search(df, F.lit(None).cast("boolean")).isEmpty()
