"""Hard negatives by one-dimensional distance keys.

Integer vectors x are put on a sphere by one more coordinate, sqrt(M * M - |x| * |x|) with M the largest length, queries q are drawn to
length M and get a zero there: then |q' - x'|^2 = 2 M^2 - 2 q.x M / |q|, so the nearest row is the one with the largest inner product. Every row belongs to the
pivot nearest to it and is stored in the order of (pivot, distance to it), cut into blocks: key intervals. A row at distance r or less
of a query lies in the annulus d(q, p) - r .. d(q, p) + r of its pivot, and, as it is nearer to its own pivot than to the query's,
r is at least half of d(q, p) less the query's distance to its nearest pivot. A query looks at intervals of growing r; the k-th best
so far bounds the r that is still needed, and when all intervals within it are seen, the result is certain.

Bounds are reals with a margin that only widens a search; scores and their comparisons are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import in_batches, materialize, table

#: Pivots are fitted to at most SAMPLE rows (those with the least hash of the vector); there are at most PIVOTS of them, one for every
#: PER_PIVOT rows of the sample's share. Labels fall into BUCKETS parts of the index.
SAMPLE, PIVOTS, PER_PIVOT, BUCKETS = 4096, 256, 2048, 16
#: Rows of a block, and queries that meet it in one task, at most.
BLOCK, ASKING = 2048, 2048
#: Share of the radius of the k-th best so far that the second scan reaches; the third reaches all of it.
HALF = 0.5


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, asked): rows that take part, their components as floor(256 * x), whole numbers in doubles."""
    good = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    v = F.transform("embedding", lambda x: _floor(256 * x.cast("double")))
    return vectors.where(good).select("vec_id", F.col("label").cast("bigint").alias("label"), v.alias("v"), "asked")


def _floor(x: Column) -> Column:
    """floor as a double; doubles of 2^52 and more are whole already (Spark's floor is a bigint, which cannot hold them)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Rows of equal vector and label once: cid (the smallest id), label, v, ids (the k + 1 smallest: no result holds more of them)."""
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v", "label").orderBy("vec_id"))).where(F.col("r") <= k + 1)  # limited before the shuffle
    return first.groupBy("v", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "label", "v", "ids")


def _pad(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(found: DataFrame, n: int, longest: float) -> dict[int, np.ndarray]:
    """Pivots (augmented) by vector length, from a sample: a few rounds of k-means."""
    rows = found.orderBy(F.xxhash64("v"), "cid").limit(SAMPLE).select("v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    out, most = {}, max(1, min(PIVOTS, n // PER_PIVOT))
    for dim, vs in by.items():
        x = augmented(np.array(vs, float).reshape(len(vs), dim), longest)
        p = x[: max(1, min(len(x), math.ceil(most * len(vs) / len(rows))))].copy()
        for _ in range(5):
            near = distances(x, p).argmin(axis=1)
            for i in range(len(p)):
                if (near == i).any():
                    p[i] = x[near == i].mean(axis=0)
        out[dim] = p
    return out


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1, keepdims=True)))])


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)))


def _pivots(held: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Of a length that the sample did not hold: the origin."""
    return held.get(dim, np.zeros((1, dim + 1)))


def _per_length(columns: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of the rows with it) of a column of vectors."""
    sizes = np.asarray(columns.value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _keyed(found: DataFrame, pivots: dict[int, np.ndarray], longest: float) -> DataFrame:
    """Adds dim, bucket, pivot and distance, the row's key."""
    held = found.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors and one per length of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far, dims = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for dim, at in _per_length(b.column(2)):
                d = distances(augmented(_pad(b.column(2).take(pa.array(at))), longest), _pivots(held.value, dim))
                near[at], far[at], dims[at] = d.argmin(axis=1), d.min(axis=1), dim
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(near), pa.array(far)], names=[*b.schema.names, "dim", "pivot", "distance"])

    rows = found.select("cid", "label", "v")
    out = in_batches(rows, run, "cid long, label long, v array<double>, dim int, pivot int, distance double")
    return out.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))


KEY = ["dim", "bucket", "pivot"]


def index(found: DataFrame, pivots: dict[int, np.ndarray], longest: float) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, dim, ids, labels, x: rows of a key interval, packed) and their directory (block, dim, bucket, pivot, low, high).

    Rows are range-partitioned by key and cut where a key's rows in a partition reach BLOCK, so that neither a hot pivot nor equal
    distances make a large block.
    """
    keyed = _keyed(found, pivots, longest)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "distance", "cid"]
    stored = keyed.select(*order, "label", "v").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            nonlocal number, held
            t = pa.Table.from_batches(held).combine_chunks()
            first, d = [t[c][0].as_py() for c in KEY], t["distance"]
            row = [part << 32 | number, *first, d[0].as_py(), d[-1].as_py(), t["cid"].to_numpy().tobytes(), t["label"].to_numpy().tobytes(), _pad(t["v"]).astype(float).tobytes()]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", *KEY, "low", "high", "ids", "labels", "x"]
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)]) if b.num_rows else np.zeros((3, 0), int)
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                while s < e:
                    if held and [held[0].column(i)[0].as_py() for i in range(3)] != keys[:, s].tolist():
                        yield packed()
                    take = min(e - s, BLOCK - sum(map(len, held)))
                    held.append(b.slice(s, take))
                    s += take
                    if sum(map(len, held)) == BLOCK:
                        yield packed()
        if held:
            yield packed()

    blocks = in_batches(stored, run, "block long, dim int, bucket int, pivot int, low double, high double, ids binary, labels binary, x binary")
    blocks = materialize(blocks, "negatives-blocks")
    return blocks, blocks.select("block", *KEY, "low", "high")


def placed(queries: DataFrame, pivots: dict[int, np.ndarray], longest: float) -> DataFrame:
    """(q, label, v) with dim, bucket, square (|q|^2), own (distance to the nearest pivot) and to (distances to all pivots of its length)."""
    held = queries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to: list = [None] * b.num_rows
            square, dims = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for dim, at in _per_length(b.column(2)):
                x = _pad(b.column(2).take(pa.array(at)))
                square[at], dims[at] = (x * x).sum(axis=1), dim
                drawn = x * (longest / np.sqrt(np.where(square[at] > 0, square[at], 1.0)))[:, None]
                d = distances(np.hstack([drawn, np.zeros((len(x), 1))]), _pivots(held.value, dim))
                for i, row in zip(at.tolist(), d.tolist(), strict=True):
                    to[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(square), pa.array(to, pa.list_(pa.float64()))], names=[*b.schema.names, "dim", "square", "to"])

    out = in_batches(queries, run, "q long, label long, v array<double>, dim int, square double, to array<double>")
    return out.withColumns({"own": F.coalesce(F.array_min("to"), F.lit(0.0)), "bucket": F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")})


def visits(asked: DataFrame, directory: DataFrame, same_bucket: bool, longest: float) -> DataFrame:
    """(q, block) of the intervals within reach (a column of asked) and beyond `seen`, the reach of the scans before."""
    each = asked.select("q", "dim", F.col("bucket").alias("q_bucket"), "own", "seen", "reach", F.posexplode("to").alias("pivot", "d"))
    on = ["dim", "pivot"]
    met = each.join(directory, on)
    met = met.where("bucket = q_bucket") if same_bucket else met
    least = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), (F.col("d") - F.col("own")) / 2, F.lit(0.0)) - F.lit(1e-6 * (longest + 1))
    return met.withColumn("least", least).where("least <= reach and (seen is null or least > seen)").select("q", "block")


def scan(asked: DataFrame, met: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, cap, cid, label, score): of each block that a query meets, the k best rows of its label (same) or of others.

    Of others the best with a score of at most each of the query's caps and at least its floor (arrays; a cap is null for no limit).
    A block whose queries are many meets them in parts of ASKING.
    """
    load = met.groupBy("block").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / ASKING).cast("int"))
    load = materialize(load, "negatives-load")
    asking = met.join(load, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).join(asked.select("q", F.col("label").alias("q_label"), F.col("v").alias("q_v"), "caps", "floors"), "q")
    stored = blocks.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "dim", "ids", "labels", "x")
    asking = asking.select("block", "part", "q", "q_label", "q_v", "caps", "floors")

    stored, asking = stored.toDF(*stored.columns), asking.toDF(*asking.columns)  # both come from the same tables

    def near(stored: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and asking.num_rows:
            dim = stored["dim"][0].as_py()
            ids, labels = (np.frombuffer(stored[c][0].as_py(), np.int64) for c in ("ids", "labels"))
            x, q = np.frombuffer(stored["x"][0].as_py()).reshape(len(ids), dim), _pad(asking["q_v"])
            scores = products(q, x)
            names, own = asking["q"].to_numpy(), asking["q_label"].to_numpy()
            for i, (caps, floors) in enumerate(zip(asking["caps"].to_pylist(), asking["floors"].to_pylist(), strict=True)):
                right = (labels == own[i]) == same
                for cap, floor in zip(caps, floors, strict=True):
                    ok = right if cap is None else right & (scores[i] <= cap)
                    at = np.flatnonzero(ok if floor is None else ok & (scores[i] >= floor))
                    if len(at) > k:
                        at = at[scores[i][at] >= np.partition(scores[i][at], len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
                    if len(at):
                        out.append((np.full(len(at), names[i]), [cap] * len(at), ids[at], scores[i][at]))
        return pa.table({"q": pa.array(np.concatenate([o[0] for o in out]) if out else [], pa.int64()), "cap": pa.array([c for o in out for c in o[1]], pa.int64()), "cid": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()), "score": pa.array(np.concatenate([o[3] for o in out]) if out else [], pa.int64())})

    return stored.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(near, "q long, cap long, cid long, score long")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers; one that does not fit stops the job."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    bound = math.sqrt((q * q).sum(axis=1).max()) * math.sqrt((x * x).sum(axis=1).max())
    if bound < 2.0**52:  # no partial sum is larger, so doubles hold them all
        return (q @ x.T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x.tolist()] for r in q.tolist()]
    return np.array(whole, dtype=object).astype(np.int64)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and cap, ties to the smaller id."""
    first = found.withColumn("r", F.row_number().over(W.partitionBy("q", "cap").orderBy(F.desc("score"), "cid")))
    return first.where(F.col("r") <= k).drop("r")


def search(asked: DataFrame, blocks: DataFrame, directory: DataFrame, k: int, same: bool, longest: float, shares: tuple[float, ...]) -> DataFrame:
    """(q, cap, cid, score): the k best for each query and cap. asked: placed(), with caps, floors and reach, the first radius.

    After a first scan, one for each of `shares`: the radius of the k-th best so far (of the worst cap; without k rows, that of
    the floor, or all) times the share; the last share is 1, so that the last scan sees all that can still count. Results so far
    are written.
    """
    found, state = None, materialize(asked.withColumn("seen", F.lit(None).cast("double")), "negatives-asked")
    for share in (*shares, None):
        new = scan(state, visits(state, directory, same, longest), blocks, k, same)
        found = materialize(best(new if found is None else found.unionByName(new), k), "negatives-found")
        if share is None:
            return found
        state = materialize(_grown(state, found, k, longest, share).where("reach > seen"), "negatives-asked")


def _grown(state: DataFrame, found: DataFrame, k: int, longest: float, share: float) -> DataFrame:
    """state with its reach as seen, and as reach the share of the radius that is still needed."""
    full = found.groupBy("q", "cap").agg(F.count("*").alias("n"), F.min("score").alias("worst")).select(F.col("q").alias("f_q"), F.col("cap").alias("f_cap"), "n", "worst")
    wanted = state.select("q", F.explode(F.arrays_zip("caps", "floors")).alias("z")).select("q", F.col("z.caps").alias("w_cap"), F.col("z.floors").alias("w_floor"))
    met = wanted.join(full, (F.col("q") == F.col("f_q")) & F.col("w_cap").eqNullSafe(F.col("f_cap")), "left")
    least = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.col("w_floor"))
    need = met.groupBy(F.col("q").alias("n_q")).agg(F.when(F.count_if(least.isNull()) == 0, F.min(least)).alias("least"))
    radius = F.when(F.col("least").isNull(), F.lit(3 * longest + 1)).otherwise(radius_of(F.col("square"), F.col("least"), longest))
    return state.join(need, F.col("q") == F.col("n_q")).withColumn("seen", F.col("reach")).withColumn("reach", F.greatest(F.col("seen"), radius * share)).drop("n_q", "least")


def radius_of(square: Column, score: Column, longest: float) -> Column:
    """Distance at which a row has this score; a zero query, whose scores are all 0, is as far from every row."""
    return F.when(square > 0, F.sqrt(F.greatest(F.lit(2 * longest**2) - 2 * score * longest / F.sqrt(square), F.lit(0.0)))).otherwise(F.lit(longest))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label (an integer type); other columns are not read. A row's score is the inner product of its
    components as floor(256 * x) with the anchor's. An anchor's positives are its first n_positives other rows of its label, by
    score, then id; for each, the first n_negatives rows of other labels whose score is at most the positive's and at least `least`
    hundredths of it. A negative positive score has none.

    Rows with a null id, label or vector, or a null or non-finite component take no part; a zero vector does. Vectors of different length do not meet.
    Repeated rows are rows of their own, and equal vectors of one label one entry of the index; of rows with one id each is a
    row, and equal ones ask once. Fewer rows than asked for give what there is; an empty table gives an empty result. A score beyond 64 bits stops
    the job.
    """
    k = max(n_positives, n_negatives)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = materialize(integers(rows), "negatives-rows")
    found = materialize(classes(rows, k), "negatives-classes")
    top = found.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    longest, n = math.sqrt(top[1] or 1.0) * (1 + 1e-12), top[0]
    pivots = fit(found, n, longest)
    blocks, directory = index(found, pivots, longest)
    anchors = rows.where("asked").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"))
    anchors = materialize(anchors.join(found.select(F.col("cid").alias("q"), "label", "v"), (F.col("a_label") == F.col("label")) & (F.col("a_v") == F.col("v"))).select("anchor_id", "q").distinct(), "negatives-anchors")
    queries = found.join(anchors.select(F.col("q").alias("a_q")).distinct(), F.col("cid") == F.col("a_q"), "left_semi").select(F.col("cid").alias("q"), "label", "v")
    queries = materialize(placed(queries, pivots, longest), "negatives-queries")
    none = F.array(F.lit(None).cast("bigint"))
    first = search(queries.withColumns({"caps": none, "floors": none, "reach": F.lit(0.0)}), blocks, directory, n_positives + 1, True, longest, (HALF, 1.0))
    listed = _listed(first.select("q", "score", "cid"), found, n_positives + 1)
    positives = anchors.join(listed, "q").where("vec_id <> anchor_id").withColumn("r", F.row_number().over(W.partitionBy("anchor_id", "q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= n_positives)
    positives = materialize(positives.select("anchor_id", "q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    floor = F.ceil(F.col("positive_score").cast("decimal(30,0)") * least / 100).cast("bigint")
    caps = positives.where("positive_score >= 0").select("q", "positive_score", floor.alias("floor")).distinct().groupBy("q").agg(F.sort_array(F.collect_list(F.struct("positive_score", "floor"))).alias("z"))  # (n_positives + 1) scores a query at most
    caps = caps.select(F.col("q").alias("c_q"), F.col("z.positive_score").alias("caps"), F.col("z.floor").alias("floors"))
    again = queries.join(caps, F.col("q") == F.col("c_q")).drop("c_q").withColumn("reach", radius_of(F.col("square"), F.array_max("caps"), longest))
    second = search(again, blocks, directory, n_negatives, False, longest, (1.0,))
    below = _listed(second.select("q", F.col("cap"), "score", "cid"), found, n_negatives)
    below = below.withColumn("r", F.row_number().over(W.partitionBy("q", "cap").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= n_negatives).withColumnsRenamed({"q": "n_q"})
    done = positives.join(below, (F.col("q") == F.col("n_q")) & (F.col("positive_score") == F.col("cap")))
    return done.select("anchor_id", "positive_id", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _listed(found: DataFrame, classes_: DataFrame, k: int) -> DataFrame:
    """A row per id of the classes found, k of each at most."""
    ids = classes_.select(F.col("cid").alias("c_cid"), F.slice("ids", 1, k).alias("ids"))
    return found.join(ids, F.col("cid") == F.col("c_cid")).select(*[c for c in found.columns if c != "cid"], F.explode("ids").alias("vec_id"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100; labels of ids divisible by 7 are moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)
