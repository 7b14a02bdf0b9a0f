"""Near-duplicates by similarity of word shingles, by min-hash bands and groups that only judged pairs unite.

Texts with the same set of shingles are one node, known by a 64-bit digest of the set (fp below). A SimHash fingerprint would not
do: it counts repeats, so a line that repeats often gives unlike texts the same one. Min-hash bands (BANDS of ROWS min-hashes)
deal the nodes to groups: a pair of similarity 0.8 misses all of them with a chance of 0.0007. 144 min-hashes put most pairs of a group beyond doubt; the others are judged by the similarity
of the two texts themselves.

First, SimHash's BK-trees link fingerprints at most three bits apart; that finds only the closest pairs (at 0.8 to 0.95 next to
none), so bands must follow. Then groups are read in shards (of SHARD nodes at most; larger groups are split at random, differently for every
band), and each shard sends on a forest of its likely pairs, nearest first. Pairs that pass unite classes. Then each group
that still holds more than one class is searched whole: every member outside its largest class meets every other member, in
blocks, and whatever the min-hashes cannot rule out is compared by the texts. So a pair that is rejected, or that the
split of a group keeps apart, costs no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .simhash import SEED, links, majority, shingle_hashes
from .store import in_batches, materialize, reserve

SHINGLE, SIMILARITY, SHARD = 5, 0.8, 256
BANDS, ROWS = 24, 6
#: Estimates from BANDS * ROWS min-hashes have a standard deviation of at most 0.042; outside this much of SIMILARITY they decide.
DOUBT = 0.13
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(values: np.ndarray) -> np.ndarray:
    """The upper half of the least of the shingles' hashes under each of BANDS * ROWS multipliers; values: at least one."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 1 << 10):
        np.minimum(least, (values[at : at + (1 << 10), None] * _ODD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def xxh64_of(values: np.ndarray) -> int:
    """A 64-bit digest of sorted values."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(values.tobytes(), SEED)).view(np.int64))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) to (doc_id, simhash, fp, sketch): fingerprint, digest of the shingle set and min-hashes (null without words) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            simhash, digests, sketch = [], [], []
            for t in b.column(1):  # one text at a time is spread out
                hashes = shingle_hashes(t.as_py(), shingle)
                own = np.unique(hashes)
                simhash.append(majority(hashes))
                digests.append(xxh64_of(own))
                sketch.append(min_hashes(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(simhash, np.uint64).view(np.int64)), pa.array(digests, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "simhash", "fp", "sketch"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, simhash long, fp long, sketch binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(fp, sketch) to (key, fp), a key per band."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substr("sketch", F.lit(1 + width * i), F.lit(width))) for i in range(BANDS)])
    return nodes.where("sketch is not null").select(F.explode(keys).alias("key"), "fp")


class Forest:
    """Groups of values that pairs unite."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.root.setdefault(x, x)
        while up != x:
            self.root[x] = self.root[up]
            x, up = self.root[x], self.root[self.root[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        """Whether x and y were apart until now."""
        a, b = self.top(x), self.top(y)
        self.root[max(a, b)] = min(a, b)
        return a != b


def by_group(frame: DataFrame, found, schema: str) -> DataFrame:
    """found(columns) per run of equal first values of a frame that is dealt and sorted by its first column; it returns rows."""
    width = len(schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(rows: list[np.ndarray]) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(rows[0])) + 1
            out: list[tuple] = []
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(rows[0])).tolist(), strict=True):
                out += found([x[a:b] for x in rows])
            cols = zip(*out, strict=True) if out else ((),) * width
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if "double" in s else pa.int64()) for c, s in zip(cols, schema.split(", "), strict=True)], names=[s.split()[0] for s in schema.split(", ")])

        rest: list[list[np.ndarray]] = []
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(new[0]):
                continue
            if rest and rest[-1][0][-1] == new[0][0] == new[0][-1]:
                rest.append(new)
                continue
            rows = [np.concatenate(c) for c in zip(*rest, new, strict=True)] if rest else new
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
            if cut:
                yield some([x[:cut] for x in rows])
            rest = [[x[cut:] for x in rows]]
        if rest:
            yield some([np.concatenate(c) for c in zip(*rest, strict=True)])

    return in_batches(frame, run, schema)


def matrix(sketches: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.tolist()), "<u4").reshape(len(sketches), -1)


def dealt(frame: DataFrame, group: str) -> DataFrame:
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, fp, n) of the bands that n > 1 nodes share; of bands with the same nodes, one."""
    rows = band_keys(nodes)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("sign")).where("n > 1")
    keys = materialize(counts.groupBy("n", "sign").agg(F.min("key").alias("key")).select("key", "n"), "band-counts")
    return materialize(rows.join(keys, "key").select("key", "fp", "n"), "band-rows")


def candidates(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, share), u < v: of each shard, a forest of the pairs that min-hashes do not rule out; share of those agree."""

    def found(cols: list[np.ndarray]) -> list[tuple]:
        _, fp, sketch = cols
        all_, forest, ids = matrix(sketch), Forest(), fp.tolist()
        pairs = []
        for i in range(len(ids) - 1):
            share = (all_[i + 1 :] == all_[i]).mean(axis=1)
            near = np.flatnonzero(share - similarity > -DOUBT)
            pairs += zip((-share[near]).tolist(), [ids[i]] * len(near), fp[near + i + 1].tolist(), strict=True)
        return [(min(x, y), max(x, y), -s) for s, x, y in sorted(pairs) if forest.unite(x, y)]

    salt = F.when(F.col("n") > SHARD, F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("n") / SHARD))).otherwise(F.lit(0))
    shards = rows.select(F.xxhash64("key", salt).alias("shard"), "fp").join(nodes.select("fp", "sketch"), "fp").select("shard", "fp", "sketch")
    return by_group(dealt(shards, "shard"), found, "u long, v long, share double").groupBy("u", "v").agg(F.max("share").alias("share"))


def needed(rows: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Every two members of a band that differ in label and are not ruled out by min-hashes.

    Rows are (block, u, null), a member of block whose text is needed, or (null, u, v), a pair beyond doubt. labels: (fp, label).
    """

    def found(cols: list[np.ndarray]) -> list[tuple]:
        _, left, fp, label, sketch = cols
        a, b = np.flatnonzero(left == 1), np.flatnonzero(left == 0)
        if not len(a) or not len(b):
            return []
        all_, forest, out, near = matrix(sketch), Forest(), [], []
        other, names = all_[b], label[b]
        for i in a.tolist():
            share = (other == all_[i]).mean(axis=1)
            for j in np.flatnonzero((share - similarity >= DOUBT) & (names != label[i])).tolist():
                if forest.unite(int(label[i]), int(names[j])):
                    out.append((None, int(fp[i]), int(fp[b[j]])))
            near.append(np.flatnonzero((share - similarity > -DOUBT) & (names != label[i])))
        tops = np.fromiter((forest.top(x) for x in label.tolist()), np.int64, len(label))
        members: set[int] = set()
        for i, js in zip(a.tolist(), near, strict=True):
            js = b[js]
            js = js[tops[js] != tops[i]]
            if len(js):
                members.add(int(fp[i]))
                members.update(fp[js].tolist())
        own = sorted(members)
        block = xxh64_of(np.array(own, np.int64))
        return out + [(block, x, None) for x in own]

    at = materialize(rows.join(labels, "fp").select("key", "fp", "label"), "band-labels")
    sizes = at.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("most"))
    mixed = materialize(sizes.select("key", "n", (F.col("n") - F.col("most.c")).alias("s"), F.col("most.label").alias("most")).where("s > 0"), "mixed-bands")
    lefts, rights = F.ceil(F.col("s") / (2 * SHARD)), F.ceil(F.col("n") / (2 * SHARD))
    c, e = F.pmod(F.xxhash64("fp", "key", F.lit(1)), lefts), F.pmod(F.xxhash64("fp", "key"), rights)
    members = at.join(mixed, "key")
    as_left = members.where("label <> most").select("key", "fp", "label", F.lit(1).alias("left"), c.alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), rights - 1)).alias("e"))
    as_right = members.select("key", "fp", "label", F.lit(0).alias("left"), F.explode(F.sequence(F.lit(0).cast("bigint"), lefts - 1)).alias("c"), e.alias("e"))
    blocks = as_left.unionByName(as_right).select(F.xxhash64("key", "c", "e").alias("block"), "left", "fp", "label").join(nodes.select("fp", "sketch"), "fp")
    return by_group(dealt(blocks.select("block", "left", "fp", "label", "sketch"), "block"), found, "block long, u long, v long").distinct()


def similar_pairs(ids: list[int], labels: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of the pairs of sets of at least this similarity that unite different labels."""
    sizes, forest, out = np.array([len(s) for s in sets]), Forest(), []
    gram, flat = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(flat, kind="stable")]
    count = np.bincount(flat, minlength=len(gram))
    start, ends = np.cumsum(count) - count, np.cumsum(sizes)
    for i in range(len(sets) - 1):
        own = flat[ends[i] - sizes[i] : ends[i]]
        n = count[own]
        shared = np.bincount(holder[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(shared / (sizes[i] + sizes - shared) >= similarity).tolist():
            if j > i and forest.unite(labels[i], labels[j]):
                out.append((ids[i], ids[j]))
    return out


def both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """pairs with the value of u as a and of v as b; of: (fp, value)."""
    left, right = of.select(F.col("fp").alias("u"), F.col(value).alias("a")), of.select(F.col("fp").alias("v"), F.col(value).alias("b"))
    return pairs.join(left, "u").join(right, "v")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) to (fp, grams): the different shingles' hashes, a row per set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):  # a batch per text bounds memory
                h = shingle_hashes(t.as_py(), shingle)
                own = np.unique(h)
                yield pa.RecordBatch.from_arrays([pa.array([xxh64_of(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["fp", "grams"])

    return in_batches(docs.select("text"), run, "fp long, grams array<long>").dropDuplicates(["fp"])


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def sets_of(docs: DataFrame, nodes: DataFrame, fps: DataFrame, shingle: int) -> DataFrame:
    """(fp, grams) of the texts of fps (a column fp)."""
    low = fps.distinct().join(nodes.select("fp", "low"), "fp").select(F.col("low").alias("n_id")).distinct()
    texts = docs.select("doc_id", "text").join(low, F.col("doc_id") == F.col("n_id"), "left_semi")
    return materialize(shingle_sets(texts, shingle), "shingle-sets")


def tree_links(nodes: DataFrame) -> DataFrame:
    """(u, v) of nodes (fp, simhash) that BK-trees link by their fingerprints, and of every node with the first of its fingerprint."""
    first = materialize(nodes.groupBy("simhash").agg(F.min("fp").alias("first")), "fingerprint-nodes")
    left, right = first.toDF("u", "a"), first.toDF("v", "b")
    near = links(first.select(F.col("simhash").alias("fp"))).join(left, "u").join(right, "v").select("a", "b")
    equal = nodes.join(first, "simhash").where(F.col("fp") != F.col("first")).select("fp", "first")
    return near.unionAll(equal).toDF("a", "b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def likely_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of candidates whose texts are similar enough."""
    told = materialize(candidates(rows, nodes, similarity), "candidates")
    doubt = told.where(F.col("share") - similarity < DOUBT).select("u", "v").unionByName(tree_links(nodes).join(told, ["u", "v"], "left_anti"))
    doubt = materialize(doubt, "doubtful-pairs")
    sets = sets_of(docs, nodes, doubt.select(F.explode(F.array("u", "v")).alias("fp")), shingle)
    judged = both(doubt, sets, "grams").where(jaccard(F.col("a"), F.col("b")) >= similarity).select("u", "v")
    return materialize(told.where(F.col("share") - similarity >= DOUBT).select("u", "v").unionByName(judged), "likely-links")


def other_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, labels: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (u, v) that unite all classes (labels: fp, label) of which a band holds two members whose texts are similar enough."""
    found = materialize(needed(rows, nodes, labels, similarity), "needed")
    members = found.where("v is null").select("block", F.col("u").alias("fp"))
    sets = sets_of(docs, nodes, members.select("fp"), shingle)

    def judge(t: pa.Table) -> pa.Table:
        t = t.sort_by("fp")
        sets = [np.asarray(x.values) for x in t.column("grams")]
        pairs = similar_pairs(t.column("fp").to_pylist(), t.column("label").to_pylist(), sets, similarity)
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    judged = members.join(labels, "fp").join(sets, "fp").groupBy("block").applyInArrow(judge, "u long, v long")
    return materialize(found.where("v is not null").select("u", "v").unionByName(judged), "other-links")


def classes(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(fp, label): the class of every node, named by one of them. nodes: (fp, low, sketch), low being the smallest doc_id of fp."""

    def named(links: DataFrame) -> DataFrame:
        return materialize(nodes.select("fp").join(components(links).withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("label")), "labels")

    rows = band_rows(nodes)
    likely = likely_links(docs, nodes, rows, shingle, similarity)
    others = other_links(docs, nodes, rows, labels := named(likely), shingle, similarity)
    return labels if others.isEmpty() else named(likely.unionByName(others))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fp, component_id of every row of (doc_id, text).

    fp is the SimHash fingerprint. component_id is the smallest doc_id in the class of the row: classes are chains of texts of
    at least this similarity. Null, empty and blank texts are a class. Repeated rows keep a row each; an empty table gives an
    empty result; extra columns are ignored.
    """
    prints = materialize(sketches(docs, shingle), "sketches")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"), F.min("simhash").alias("simhash")), "nodes")
    named = nodes.select("fp", "low").join(classes(docs, nodes, shingle, similarity).withColumnRenamed("label", "root"), "fp")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(named.join(least, "root").select(F.col("fp").alias("k"), "component_id"), "classes")
    return prints.join(of, F.col("fp") == F.col("k")).select("doc_id", F.col("simhash").alias("fp"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id and, of rows that share it, the least text. Rows without a doc_id stay."""
    reserve(docs, "component_id", "fp", "k_id", "r")
    known = near_duplicates(docs.where("doc_id is not null"), shingle, similarity)
    kept = known.where("doc_id = component_id").select(F.col("doc_id").alias("k_id")).distinct()
    rows = docs.join(kept, F.col("doc_id") == F.col("k_id"), "left_semi")
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("r = 1").drop("r")
    return first.unionByName(docs.where("doc_id is null"))
