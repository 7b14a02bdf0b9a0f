"""Prefix tree of conversations, built compressed (Patricia).

A prefix of a conversation is known by a 120-bit digest chain: the exclusive or of digests of its turns with their depths, a running
value. Every node belongs to the smallest conversation that passes it (its owner), so a conversation owns a run of its turns: those
deeper than any smaller conversation follows it. Points are the nodes that branch, that end a conversation, or have no children, and
the root; the turns of one owner between two points are a compressed edge. Sums over subtrees are taken on the points alone, by
doubling: each round adds the sums of the points 2^i steps below and doubles the step, so the rounds are the logarithm of the
longest path of points. The nodes along an edge then follow from its lower point and sums from the node to the edge's end.

Everything is DataFrame work but the digest of ending conversations, a SHA-256 over a node's sorted ids, which is a stream by
nature: ids go through a task in order, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import in_ranges, running
from .store import in_batches, materialize, table

#: Characters of a text that order turns of one number and role, before its digest does.
HEAD = 64
#: Of op11: conversations share a stem by hundreds, of at most STEMS - 1 turns.
HUNDRED, STEMS = 100, 6


def _held(name: str):
    return lambda df: materialize(df, name)


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, chars): a row per turn with its place in the conversation from 0, digest and code points.

    Order is turn (null first), then role, then the text's first HEAD characters, then digest. Null roles and texts are empty. Rows
    without a conv_id take no part. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda i: F.conv(F.substr("sha", F.lit(i), F.lit(15)), 16, 10).cast("bigint")
    slim = df.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.substr(text, F.lit(1), F.lit(HEAD)).alias("head"), F.length(text).cast("bigint").alias("chars"), digest.alias("sha"))
    slim = slim.select("conv_id", "turn", "role", "head", part(1).alias("a"), part(16).alias("b"), "chars")
    order = ["turn", "role", "head", "a", "b"]
    placed = running(in_ranges(slim, ["conv_id"], order, _held("trie-turns")), ["conv_id"], order, sums={"place": F.lit(1)})
    return materialize(placed.select("conv_id", (F.col("place") - 1).alias("place"), "a", "b", "chars"), "trie-places")


def with_stems(own: DataFrame) -> DataFrame:
    """Conversations (conv_id, place, a, b, chars; of each at least a row, whose place is null where it has no turns) rebuilt: the first
    h turns of the conversation at the start of their hundred, then their own after the first h; h is the id's CRC-32 modulo STEMS."""
    h = F.crc32(F.col("conv_id").cast("string")) % STEMS
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    stems = materialize(own.where(F.col("place") < STEMS).where(F.col("conv_id") == base).select(F.col("conv_id").alias("s_id"), F.col("place").alias("s_place"), "a", "b", "chars"), "trie-stems")
    sizes = stems.groupBy("s_id").agg(F.count("*").alias("n_stem"))
    convs = own.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    first = convs.join(stems, (F.col("base") == F.col("s_id")) & (F.col("s_place") < F.col("h")), "left").select("conv_id", F.col("s_place").alias("place"), "a", "b", "chars")
    rest = own.where(F.col("place") >= h).join(sizes, base == F.col("s_id"), "left")
    rest = rest.select("conv_id", (F.col("place") - h + F.least(h, F.coalesce("n_stem", F.lit(0)))).alias("place"), "a", "b", "chars")
    return first.unionByName(rest)


def chained(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, chars, cum): p the digests of the prefix of that depth, q of the one before, cum the code points up to here."""
    a, b = F.xxhash64("place", "a", "b"), F.xxhash64("b", "place", "a", F.lit(7))
    placed = in_ranges(rows.where("place is not null").withColumns({"x": a, "y": b}).drop("a", "b"), ["conv_id"], ["place"], _held("trie-terms"))
    run = running(placed, ["conv_id"], ["place"], sums={"cum": F.col("chars")}, xors={"p1": F.col("x"), "p2": F.col("y")})
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    before = pair(F.col("p1").bitwiseXOR(F.col("x")), F.col("p2").bitwiseXOR(F.col("y")))
    return materialize(run.select("conv_id", (F.col("place") + 1).alias("depth"), pair(F.col("p1"), F.col("p2")).alias("p"), before.alias("q"), "chars", "cum"), "trie-chain")


def ends(chain: DataFrame, convs: DataFrame) -> DataFrame:
    """(e_p, n_ends, ends_sha256) of the prefixes that are a whole conversation; the empty prefix is that of conversations without turns."""
    last = chain.groupBy("conv_id").agg(F.max_by("p", "depth").alias("p"))
    all_ = convs.join(last, "conv_id", "left").select(F.coalesce("p", _root()).alias("p"), "conv_id").select("p.x", "p.y", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, None, 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "n_ends", "ends_sha256"])
            out.clear()
            return got

        for b in batches:
            for x, y, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (x, y):
                    if now is not None:
                        out.append((*now, n, state.hexdigest()))
                    now, state, n = (x, y), hashlib.sha256(), 0
                state.update(f"{',' if n else ''}{c}".encode())
                n += 1
            if len(out) > 10_000:
                yield flush()
        if now is not None:
            out.append((*now, n, state.hexdigest()))
        yield flush()

    sorted_ = all_.repartition("x", "y").sortWithinPartitions("x", "y", "conv_id")
    return in_batches(sorted_, run, "x long, y long, n_ends long, ends_sha256 string").select(F.struct("x", "y").alias("e_p"), "n_ends", "ends_sha256")


def _root() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))


def nodes(chain: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per prefix: conv_id (its owner), depth, p, q, n_convs, chars, cum, n_children, n_ends, ends_sha256, point."""
    met = chain.groupBy("p").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.first("depth").alias("o_depth")).drop("p")
    own = chain.join(met, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("o_depth"))).drop("owner", "o_depth")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null")
    zero = F.lit(0).cast("bigint")
    root = root.select("conv_id", zero.alias("depth"), _root().alias("p"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("q"), zero.alias("chars"), zero.alias("cum"), "n_convs")
    own = materialize(own.unionByName(root), "trie-nodes")
    fields = ["conv_id", "depth", "q", "n_convs", "chars", "cum"]
    none = F.lit(None)
    self_ = own.select("p", F.struct(*fields).alias("s"), F.lit(0).alias("kid"), none.cast("bigint").alias("n_ends"), none.cast("string").alias("sha"))
    kids = own.where("q is not null").select(F.col("q").alias("p"), none.cast(self_.schema["s"].dataType).alias("s"), F.lit(1).alias("kid"), none.cast("bigint").alias("n_ends"), none.cast("string").alias("sha"))
    ended = ends(chain, convs).select(F.col("e_p").alias("p"), none.cast(self_.schema["s"].dataType).alias("s"), F.lit(0).alias("kid"), "n_ends", F.col("ends_sha256").alias("sha"))
    out = self_.unionByName(kids).unionByName(ended).groupBy("p").agg(F.max("s").alias("s"), F.sum("kid").alias("n_children"), F.coalesce(F.max("n_ends"), zero).alias("n_ends"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = out.select("p", *[F.col(f"s.{c}").alias(c) for c in fields], "n_children", "n_ends", "ends_sha256")
    return out.withColumn("point", ((F.col("n_children") != 1) | (F.col("n_ends") > 0) | (F.col("depth") == 0)).cast("bigint"))


def summed(points: DataFrame) -> DataFrame:
    """points (conv_id, edge, up_conv, up_edge, leaves, saved) with leaves and saved summed over their subtrees, by doubling."""
    state = points
    while not (up := state.where("up_conv is not null")).isEmpty():
        below = up.groupBy(F.col("up_conv").alias("b_conv"), F.col("up_edge").alias("b_edge")).agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        step = up.select(F.col("conv_id").alias("j_conv"), F.col("edge").alias("j_edge"), F.col("up_conv").alias("j_up"), F.col("up_edge").alias("j_up_edge"))
        state = state.join(below, (F.col("conv_id") == F.col("b_conv")) & (F.col("edge") == F.col("b_edge")), "left")
        state = state.join(step, (F.col("up_conv") == F.col("j_conv")) & (F.col("up_edge") == F.col("j_edge")), "left")
        plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        state = materialize(state.select("conv_id", "edge", F.col("j_up").alias("up_conv"), F.col("j_up_edge").alias("up_edge"), plus("leaves", "b_leaves"), plus("saved", "b_saved")), "trie-sums")
    return state


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per distinct prefix.

    rows: conv_id, place (from 0, gapless), a, b (digest of the turn), chars; a conversation without turns is one row of null place.
    A table without rows has no tree. conv_id of a node is its smallest member; saved_tokens counts code points. Conversations
    that are equal end at one node.
    """
    rows = materialize(rows, "trie-rows")
    convs = materialize(rows.select("conv_id").distinct(), "trie-convs")
    chain = chained(rows)
    placed = in_ranges(nodes(chain, convs), ["conv_id"], ["depth"], _held("trie-points"))
    run = running(placed, ["conv_id"], ["depth"], sums={"up_to": F.col("point")}, lags={"after": F.col("depth")})
    whole = materialize(run.select(*[c for c in placed.columns if c != "__range"], (F.col("up_to") - F.col("point")).alias("edge"), F.col("after").isNull().alias("top")), "trie-edges")
    at = lambda c: F.max_by(c, "depth").alias(c)
    edges = whole.groupBy("conv_id", "edge").agg(at("p"), at("n_children"), F.max("n_convs").alias("n_convs"), F.sum("chars").alias("edge_chars"), F.max("cum").alias("end"), F.max(F.when(F.col("top"), F.col("q"))).alias("q"))
    edges = materialize(edges, "trie-compressed")
    above = edges.select(F.col("p").alias("u_p"), F.col("conv_id").alias("u_conv"), F.col("edge").alias("u_edge"))
    tops = edges.where("q is not null").select(F.col("conv_id").alias("t_conv"), "q").join(above, F.col("q") == F.col("u_p")).select("t_conv", "u_conv", "u_edge")  # a row per owner but the root's
    linked = edges.join(tops, (F.col("conv_id") == F.col("t_conv")) & (F.col("edge") == 0), "left")
    up_conv = F.when(F.col("edge") > 0, F.col("conv_id")).otherwise(F.col("u_conv"))
    up_edge = F.when(F.col("edge") > 0, F.col("edge") - 1).otherwise(F.col("u_edge"))
    saved = (F.col("n_convs") - 1) * F.col("edge_chars")
    linked = materialize(linked.select("conv_id", "edge", up_conv.alias("up_conv"), up_edge.alias("up_edge"), F.when(F.col("n_children") == 0, F.lit(1)).otherwise(0).cast("bigint").alias("leaves"), saved.alias("own"), "end", "u_conv"), "trie-linked")
    sums = summed(linked.select("conv_id", "edge", "up_conv", "up_edge", "leaves", F.col("own").alias("saved")))
    below = linked.select("conv_id", "edge", "own", "end", "u_conv").join(sums.select("conv_id", "edge", "leaves", "saved"), ["conv_id", "edge"]).select(F.col("conv_id").alias("e_conv"), F.col("edge").alias("e_edge"), "leaves", (F.col("saved") - F.col("own")).alias("under"), "end", "u_conv")
    out = whole.join(below, (F.col("conv_id") == F.col("e_conv")) & (F.col("edge") == F.col("e_edge")))
    suffix = F.col("end") - F.col("cum") + F.col("chars")
    parent = F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("u_conv")).otherwise(F.col("conv_id")))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("under") + (F.col("n_convs") - 1) * suffix).alias("saved_tokens"), "ends_sha256")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all conversations, rebuilt with the stems of their hundreds."""
    return trie(with_stems(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
