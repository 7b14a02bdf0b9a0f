"""SimHash near-duplicates: fingerprints from word shingles, links found with BK-trees, classes by connected components.

Different fingerprints (with their smallest doc_id) are dealt to shards by bands: among four bands of 16 bits, two
fingerprints at most 3 bits apart agree on one. A shard above SHARD fingerprints is dealt again by four bands of the other
48 bits, by the same argument. Each shard grows its own BK-tree in the task that holds it, so no tree is broadcast: the trees
together hold every fingerprint several times, which has no size bound. A tree gives each fingerprint its neighbours
within the radius; the shard sends on one link per member of each group it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import in_batches, materialize, table

RADIUS, SHINGLE, SEED, SHARD = 3, 3, 42, 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included; a text of fewer words has one, a text without words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    first = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    last = ends[k - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def majority(values: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, fp), fp as a signed 64-bit number; whole texts, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Children of a node are keyed by their distance to it, so a search follows only edges within the radius of its own distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        n = len(self.values)
        self.values.append(x)
        self.children.append({})
        at = 0
        while n:
            d = (self.values[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = n
                return
            at = below

    def near(self, x: int, radius: int) -> list[int]:
        """Positions of the values within radius of x, in no order."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            kids = self.children[at]
            if kids:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
        return out


def linked(values: list[int], radius: int) -> list[int]:
    """For each value the position of the first of its group, groups being joined by links within radius."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.near(x, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(x)
    return [top(i) for i in range(len(values))]


def shard_links(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(shard, fp), dealt and sorted by shard, to links (u, v) between fingerprints of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(shard)) + 1
            u: list[int] = []
            v: list[int] = []
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(shard)).tolist(), strict=True):
                if b - a > 1:
                    own = fp[a:b]
                    roots = linked(own.view(np.uint64).tolist(), radius)
                    for i, r in enumerate(roots):
                        if i != r:
                            u.append(int(own[i]))
                            v.append(int(own[r]))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            shard, fp = np.append(shard, b.column(0).to_numpy(zero_copy_only=False)), np.append(fp, b.column(1).to_numpy(zero_copy_only=False))
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on in the next batch
            if cut:
                yield groups(shard[:cut], fp[:cut])
                shard, fp = shard[cut:], fp[cut:]
        if len(shard):
            yield groups(shard, fp)

    return in_batches(shards.select("shard", "fp"), run, "u long, v long")


def _bits(c: str, start: int, n: int) -> F.Column:
    return F.shiftrightunsigned(F.col(c), start).bitwiseAND((1 << n) - 1)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) whose closure joins exactly the fingerprints that chains of steps of at most radius bits join.

    fps: a written table of different values fp. radius is at most 3, for the bands to be complete.
    """
    if not 0 <= radius <= 3:
        raise ValueError("bands are complete up to 3 bits")
    bands = F.array(*[F.struct(F.lit(i).alias("band"), _bits("fp", 16 * i, 16).alias("value")) for i in range(4)])
    dealt = fps.select("fp", F.explode(bands).alias("b")).select("fp", (F.col("b.band") * 65536 + F.col("b.value")).cast("bigint").alias("key"))
    count = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keys = materialize(count, "bands")
    found = dealt.join(keys, "key")
    band = F.floor(F.col("key") / 65536)
    rest = F.when(band == 0, F.shiftrightunsigned("fp", 16))
    for i in (1, 2, 3):
        low = F.col("fp").bitwiseAND((1 << 16 * i) - 1)
        rest = rest.when(band == i, low if i == 3 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * (i + 1)), 16 * i)))
    again = found.where(F.col("n") > SHARD).withColumn("rest", rest)
    sub = F.explode(F.array(*[F.struct(F.lit(i).alias("sub"), _bits("rest", 12 * i, 12).alias("value")) for i in range(4)]))
    fine = again.select("fp", "key", sub.alias("s")).select((F.col("key") * 4 + F.col("s.sub")).alias("key"), (F.col("s.value") + 1).alias("value"), "fp")
    shards = found.where(F.col("n") <= SHARD).select(F.col("key") * 4, F.lit(0).alias("value"), "fp").toDF("key", "value", "fp").unionByName(fine)
    shards = shards.select((F.col("key") * 8192 + F.col("value")).alias("shard"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shard_links(shards.repartition(n, "shard").sortWithinPartitions("shard", "fp"), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row of (doc_id, text).

    component_id is the smallest doc_id in the class of the row. Null, empty and blank texts have fingerprint zero and link
    like any other. Repeated rows keep a row each; an empty table gives an empty result; extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), radius))
    named = distinct.join(joined.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("v", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(named.join(least, "root").select(F.col("fp").alias("k"), "component_id"), "classes")
    return prints.join(of, F.col("fp") == F.col("k")).drop("k")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint (hexadecimal) and class."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
