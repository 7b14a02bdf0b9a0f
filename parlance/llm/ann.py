"""Approximate nearest neighbours by inner product on shifted Hilbert curves.

Vectors of one length M (the largest) stand on a sphere; shorter ones get one more coordinate that puts them there, queries get
length M and a zero, so that the nearest by distance is the largest by inner product. Each of several curves projects the
points at random, shifts them, and orders them by their Hilbert key. Spark range-partitions a curve's keys, and a query looks at the
points up to `window` ranks from its own place on every curve. The best of all curves are merged by their exact inner products.

The window is fitted to the table: SAMPLE queries are compared with all points, and the window is the number of ranks within
which FITTED of their true neighbours stand on some curve. Vectors that lie near a surface of few dimensions need short windows;
vectors without any structure need windows that grow nearly with the table, by this or any other order.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import in_batches, materialize, table

#: Dimensions of a projection and bits of each in a key; curves; rows of a block at most.
PROJECTED, BITS, CURVES, BLOCK = 8, 7, 32, 32_768
#: Queries that the window is fitted to, and the share of their neighbours that it must reach.
SAMPLE, FITTED = 256, 0.93


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of cells (n, d) of unsigned numbers below 2 ** bits along the Hilbert curve; bits * d is at most 63."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, from the coarsest
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(d):
            mirror = (x[i] & q) != 0
            swap = np.where(mirror, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirror, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint64(level)) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_keys(points: np.ndarray, curve: int, seed: int) -> np.ndarray:
    """Keys of points on the unit sphere along one of the curves."""
    rng = np.random.default_rng([seed, curve])
    n = points.shape[1]
    axes = np.linalg.qr(rng.normal(size=(n, min(PROJECTED, n))))[0]
    spread = (points @ axes) * math.sqrt(n) / 8 + 0.5 + rng.uniform(-0.0625, 0.0625, axes.shape[1])  # four deviations each way
    return hilbert(np.clip(spread * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, asked): finite vectors other than zero, as floats or doubles."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # no negative zeros
    good = "vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    return vectors.select("vec_id", v.alias("v"), "asked").where(good)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors once: cid (the smallest id), v, ids (the k + 1 smallest: no result holds more of them)."""
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)  # limited before the shuffle
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _keyed(points: DataFrame, longest: float, curves: int, seed: int) -> DataFrame:
    """(cid, v, queried) to a row per curve for the point, and one more if it is a query: curve, key, cid, query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, queried = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            point = np.hstack([x, np.sqrt(np.maximum(0, longest**2 - length**2))]) / longest
            query = np.hstack([x / length, np.zeros_like(length)])[queried]
            for curve in range(curves):
                keys = np.concatenate([curve_keys(point, curve, seed), curve_keys(query, curve, seed)])
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, curve, np.int32)), pa.array(keys), pa.array(np.concatenate([ids, ids[queried]])), pa.array(np.arange(n) >= len(ids))], names=["curve", "key", "cid", "query"])

    return in_batches(points.select("cid", "v", "queried"), run, "curve int, key long, cid long, query boolean")


def _ranked(keyed: DataFrame) -> DataFrame:
    """Adds rank: how many points (queries do not count) come before along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, curve_now, n = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            curve, points = b.column(0).to_numpy(), ~b.column(3).to_numpy(zero_copy_only=False)
            local = np.zeros(b.num_rows, np.int64)
            cut = np.append(np.append(0, np.flatnonzero(np.diff(curve)) + 1), b.num_rows) if b.num_rows else np.zeros(1, int)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if curve[s] != curve_now:
                    curve_now, n = int(curve[s]), 0
                sums = np.cumsum(points[s:e])
                local[s:e] = n + sums - points[s:e]
                n += int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local"])

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionByRange(n, "curve", "key", "cid", "query").sortWithinPartitions("curve", "key", "cid", "query")
    placed = materialize(in_batches(sorted_, run, keyed.schema.simpleString()[7:-1].replace(":", " ") + ", part int, local long"), "curve-ranks")
    sizes = placed.groupBy("curve", "part").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(sizes.select(F.col("curve").alias("o_curve"), F.col("part").alias("o_part"), before.alias("before")), "curve-offsets")
    return placed.join(offsets, (F.col("curve") == F.col("o_curve")) & (F.col("part") == F.col("o_part"))).select("curve", "cid", "query", (F.col("before") + F.col("local")).alias("rank"))


def best(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of x for q by (exact inner product, smaller id): ids and products. scores: products that are wrong by `slack` at most."""
    near = np.arange(len(scores))
    if len(near) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * slack)
    exact = np.cumsum(x[near] * q, axis=1)[:, -1] + 0.0  # one after another, as Spark's fold does
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def _slack(x: np.ndarray, q: np.ndarray) -> float:
    """More than any order of summation can change the products."""
    return 4e-16 * x.shape[1] * float(np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1).max()))


def true_neighbours(points: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, cid) of the k nearest other points of a few queries (rows of cid, v), by a scan of all points."""
    qid, q = np.array([r.cid for r in sample]), np.array([r.v for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            scores, slack, out = q @ x.T, _slack(x, q), []
            for i, own in enumerate(qid.tolist()):
                others = ids != own
                got, score = best(scores[i][others], x[others] if not others.all() else x, q[i], ids[others], k, slack)
                out.append((np.full(len(got), own), got, score))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["q", "cid", "score"])

    found = in_batches(points.select("cid", "v"), run, "q long, cid long, score double")
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k).select("q", "cid")


def fitted_window(points: DataFrame, ranked: DataFrame, k: int, sample: int, share: float) -> int:
    """The ranks within which `share` of the true neighbours of a sample of the queries stand on some curve, and three standard
    errors more: the fewer neighbours were looked at, the more of them must be in reach."""
    some = points.where("queried").orderBy(F.xxhash64("cid"), "cid").limit(sample).select("cid", "v").collect()
    truth = materialize(true_neighbours(points, some, k), "true-neighbours") if some else None
    if truth is None or truth.isEmpty():
        return k + 1
    asked = ranked.where("query").select(F.col("cid").alias("q"), F.col("curve").alias("q_curve"), F.col("rank").alias("q_rank")).join(truth.withColumnRenamed("cid", "t_cid"), "q")
    met = ranked.where("not query").join(asked, (F.col("cid") == F.col("t_cid")) & (F.col("curve") == F.col("q_curve")))
    least = met.groupBy("q", "cid").agg(F.min(F.abs(F.col("rank") - F.col("q_rank"))).alias("ranks"))
    least = materialize(least, "fitted-ranks")
    reach = min(1.0, share + 3 * math.sqrt(share * (1 - share) / least.count()))
    return max(k + 1, math.ceil(least.agg(F.percentile("ranks", F.lit(reach))).first()[0]))


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, curves: int = CURVES, sample: int = SAMPLE, share: float = FITTED, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found of all other rows.

    vectors: vec_id, embedding, and others, which are not read. Vectors that are null, zero, or hold null or non-finite components take no
    part; vectors of different lengths do not meet, each length is searched by itself. Ties, also those of different vectors, go to
    the smaller vec_id; with fewer candidates all are returned; an empty table gives an empty result. Every row is in the index: equal
    vectors share a place, so a vector that many rows hold is one point. Blocks are of bounded size, and a window that spans more
    rows takes more blocks.
    """
    rows = materialize(usable(vectors.withColumn("asked", F.coalesce(is_query, F.lit(False)))), "vectors")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    parts = [_search(rows.where(F.size("v") == n), k, curves, sample, share, seed) for n in sorted(lengths)]
    empty = rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return functools.reduce(DataFrame.unionByName, parts, empty)


def _search(rows: DataFrame, k: int, curves: int, sample: int, share: float, seed: int) -> DataFrame:
    """search() among vectors (vec_id, v, asked) of one length."""
    found = materialize(classes(rows.select("vec_id", "v"), k), "vector-classes")
    asked = rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"))
    asked = materialize(asked.join(found.select("cid", "v"), F.col("q_v") == F.col("v")).select("query_id", "cid"), "asked")
    queried = asked.select(F.col("cid").alias("q_cid")).distinct()
    points = found.join(queried, F.col("cid") == F.col("q_cid"), "left").withColumn("queried", F.col("q_cid").isNotNull()).drop("q_cid")
    points = materialize(points.select("cid", "v", "ids", "queried"), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = math.sqrt(points.agg(F.max(square)).first()[0] or 1.0)
    ranked = materialize(_ranked(_keyed(points, longest, curves, seed)), "ranked")
    window = fitted_window(points, ranked, k, sample, share)
    block = min(BLOCK, window)
    at = lambda r: F.floor(r / block).cast("long")
    placed = ranked.join(points.select(F.col("cid").alias("v_cid"), "v"), F.col("cid") == F.col("v_cid"))
    stored = placed.where("not query").select("curve", at(F.col("rank")).alias("block"), "cid", "rank", "v")
    looking = placed.where("query").select("curve", F.explode(F.sequence(at(F.col("rank") - window), at(F.col("rank") + window))).alias("block"), "cid", "rank", "v")

    def near(stored: pa.Table, looking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and looking.num_rows:
            order, asking = np.argsort(stored["rank"].to_numpy()), np.argsort(looking["rank"].to_numpy())
            x, ids, ranks = _matrix(stored["v"])[order], stored["cid"].to_numpy()[order], stored["rank"].to_numpy()[order]
            q, names, own = _matrix(looking["v"])[asking], looking["cid"].to_numpy()[asking], looking["rank"].to_numpy()[asking]
            low, high, slack = np.searchsorted(ranks, own - window), np.searchsorted(ranks, own + window, "right"), _slack(x, q)
            for a in range(0, len(q), 8):  # queries next to each other share most of their windows
                z = min(a + 8, len(q))
                scores = q[a:z] @ x[low[a] : high[z - 1]].T
                for i in range(a, z):
                    mine = slice(low[i], high[i])
                    got, score = best(scores[i - a, low[i] - low[a] : high[i] - low[a]], x[mine], q[i], ids[mine], k + 1, slack)
                    out.append((np.full(len(got), names[i]), got, score))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, [np.int64, np.int64, np.float64][j]) for j in range(3)]
        return pa.table(dict(zip(("q", "cid", "score"), cols, strict=True)))

    stored, looking = (t.toDF("curve", "block", "cid", "rank", "v") for t in (stored, looking))
    pairs = stored.groupBy("curve", "block").cogroup(looking.groupBy("curve", "block")).applyInArrow(near, "q long, cid long, score double")
    merged = pairs.groupBy("q", "cid").agg(F.max("score").alias("score"))
    top = merged.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1).select("q", F.col("cid").alias("c"), "score")
    listed = materialize(top, "nearest").join(points.select(F.col("cid").alias("c_cid"), "ids"), F.col("c") == F.col("c_cid"))
    listed = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids"))).alias("all"))  # k + 1 classes at most
    each = F.flatten(F.transform("all", lambda c: F.transform(c["ids"], lambda i: F.struct(c["minus"].alias("minus"), i.alias("vec_id")))))
    listed = listed.select("q", F.slice(F.sort_array(each), 1, k + 1).alias("near"))
    done = asked.join(listed, F.col("cid") == F.col("q")).withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return done.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", (0.0 - F.col("x.minus")).alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), F.col("vec_id") % 20 == 0)
