"""Mixing sources to target weights by exact block quotas, split among output shards along a binary tree.

Documents of a source form blocks by a keyed hash. Blocks stand in a keyed permutation; a source's quota is every block as
often as its words go into the target in whole, and then the first blocks of the permutation. The draws of all sources are an urn. A
binary tree halves the shards again and again, and at each node the draws of each source that go left are a multivariate
hypergeometric sample, by inverting the distribution around its mode with one keyed uniform a source. Each shard then draws its
number of blocks of each source, the next ones of the permutation, so that no two shards draw the same, and shuffles their
documents locally. What no shard draws is not in the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import WORD, let, materialize, table

#: Documents in a block and draws in a shard, on average at most; permutations are ranked in so many parts; orders that an edge is tried in.
BLOCK, SHARD, PARTS_LOG2, TRIALS = 256, 32, 10, 64
#: Sources of a node's row; more are split by groups first.
WIDE = 256


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size): water-filling under caps of `most` times the source's size.

    Sources by code point, null last, have the given weights in turn. A source is full at level cap / weight; the level that
    spends the whole budget lies behind the first k of them by that level, for the smallest k at which it is below the next.
    """
    order = W.orderBy(F.col("source").isNull(), "source")  # rows here are sources, not documents
    w = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = W.orderBy("full_at", F.col("source").isNull(), "source")
    w = w.withColumn("cap_before", F.sum("cap").over(every.rowsBetween(W.unboundedPreceding, -1))).withColumn("weight_from", F.sum("weight").over(every.rowsBetween(0, W.unboundedFollowing)))
    w = w.withColumn("budget", F.sum("source_size").over(W.partitionBy(F.lit(0))) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("budget") - F.coalesce("cap_before", F.lit(0.0))) / F.col("weight_from"))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct(F.col("full_at"), F.col("source").isNull().alias("last"), F.col("source"), F.col("level")))).over(W.partitionBy(F.lit(0)))
    w = w.withColumn("water", first["level"])
    return w.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))).select("source", "source_size", "n_docs", "target")


def _uniform(seed: int, *cols: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))


def ln_factorial(n: Column) -> Column:
    """Logarithm of n!: a table below 16, Stirling's series from there."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 16, F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), (F.least(n, F.lit(15)) + 1).cast("int"))).otherwise(series)


def hypergeometric(good: Column, total: Column, need: Column, u: Column) -> Column:
    """How many of `good` among `total` are in a sample of `need`, for a uniform u: values are tried from the mode outwards until their
    probabilities reach u. Ten standard deviations and 40 are tried on each side; what lies beyond is less than rounding."""
    ln_choose = lambda n, k: ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    whole = lambda c: c.cast("bigint")
    g, n, k = (c.cast("double") for c in (good, total, need))
    mode = F.greatest(F.least(whole(F.floor((k + 1) * (g + 1) / (n + 2))), good, need), need - (total - good), F.lit(0).cast("bigint"))
    deviation = F.sqrt(k * (g / n) * (1 - g / n) * (n - k) / F.greatest(n - 1, F.lit(1.0)))

    def tried(m: Column) -> Column:
        p = F.exp(ln_choose(good, m) + ln_choose(total - good, need - m) - ln_choose(total, need))
        start = F.struct(p.alias("up"), p.alias("down"), (u - p).alias("left"), F.when(u < p, m).alias("out"))

        def step(a: Column, i: Column) -> Column:
            x, y = (m + i - 1).cast("double"), (m - i + 1).cast("double")
            up = a["up"] * F.greatest(F.lit(0.0), (g - x) * (k - x)) / ((x + 1) * (n - g - k + x + 1))
            down = a["down"] * F.greatest(F.lit(0.0), y) * F.greatest(F.lit(0.0), n - g - k + y) / ((g - y + 1) * (k - y + 1))

            def both(v: Column) -> Column:
                out = F.when(a["out"].isNotNull(), a["out"]).when(a["left"] < v["up"], m + i).when(a["left"] < v["up"] + v["down"], m - i)
                return F.struct(v["up"].alias("up"), v["down"].alias("down"), (a["left"] - v["up"] - v["down"]).alias("left"), out.alias("out"))

            return let(F.struct(F.coalesce(up, F.lit(0.0)).alias("up"), F.coalesce(down, F.lit(0.0)).alias("down")), both)

        return F.coalesce(F.aggregate(F.sequence(F.lit(1).cast("bigint"), whole(F.ceil(10 * deviation)) + 40), start, step, lambda a: a["out"]), m)

    least = F.greatest(F.lit(0).cast("bigint"), need - (total - good))
    return F.when(least >= F.least(good, need), least).otherwise(let(mode, tried))


def split_tree(quotas: DataFrame, shards_log2: int, seed: int) -> DataFrame:
    """(source, quota) to (shard, source, n, before): each source's draws in 2 ** shards_log2 shards of near-equal size; n above 0.

    A node is a row with the counts of at most about WIDE sources. Of more, groups of sources are split first as if they were
    sources, which gives each group's draws at each node; the group's own sources then share these. Both ways the left counts are
    drawn without replacement from the node's urn, source after source, which is what makes them multivariate hypergeometric. A
    source without draws left in a node leaves it, so all nodes of a depth hold no more entries than there are draws.
    """
    items = quotas.where("quota > 0").select(F.struct(F.col("source").isNull().alias("last"), "source").alias("item"), "quota")
    leaves, _ = _split(items, items.count(), shards_log2, seed)
    flat = materialize(leaves.select("shard", "item.source", "n"), "mix-plan")
    return flat.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint")))


def _split(items: DataFrame, n_items: int, shards_log2: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """(item, quota) to the leaves (shard, item, n), and what went left: (depth, shard, item, left) of every node that is no leaf."""
    wide, n_groups, zero = n_items > WIDE, math.ceil(n_items / WIDE), F.lit(0).cast("bigint")
    group = F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(n_groups)).cast("bigint")
    rows = materialize(items.withColumn("grp", group), "mix-items") if wide else items.withColumn("grp", zero)
    needs = None
    if wide:
        above = rows.groupBy("grp").agg(F.sum("quota").alias("quota")).select(F.struct(F.lit(False).alias("last"), F.col("grp").cast("string").alias("source")).alias("item"), "quota")
        needs = _split(above, n_groups, shards_log2, seed + 1000)[1]
    node = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item", "quota"))).alias("urn")).withColumn("shard", zero)
    lefts = None
    for depth in range(shards_log2):
        node = node.withColumn("total", F.aggregate("urn", zero, lambda a, x: a + x["quota"]))
        if wide:
            mine = needs.where(F.col("depth") == depth).select(F.col("shard").alias("m_shard"), F.col("item.source").cast("bigint").alias("m_grp"), F.col("left").alias("to_left"))
            node = node.join(mine, (F.col("shard") == F.col("m_shard")) & (F.col("grp") == F.col("m_grp"))).drop("m_shard", "m_grp")
        else:
            node = node.withColumn("to_left", F.ceil(F.col("total") / 2).cast("bigint"))

        def deal(a: Column, x: Column) -> Column:
            u = _uniform(seed, F.lit(depth), F.col("shard"), F.col("grp"), F.size(a["out"]))
            left = hypergeometric(x["quota"], a["rest"], a["need"], u)
            return let(left, lambda n: F.struct((a["need"] - n).alias("need"), (a["rest"] - x["quota"]).alias("rest"), F.concat(a["out"], F.array(n)).alias("out")))

        start = F.struct(F.col("to_left").alias("need"), F.col("total").alias("rest"), F.array().cast("array<bigint>").alias("out"))
        cut = materialize(node.withColumn("left", F.aggregate("urn", start, deal, lambda a: a["out"])), "mix-node")
        told = cut.select(F.lit(depth).alias("depth"), "shard", F.explode(F.arrays_zip("urn", "left")).alias("z")).select("depth", "shard", F.col("z.urn.item").alias("item"), F.col("z.left").alias("left"))
        lefts = told if lefts is None else lefts.unionByName(told)
        some = lambda left: F.filter(F.zip_with("urn", "left", lambda x, n: F.struct(x["item"].alias("item"), (n if left else x["quota"] - n).alias("quota"))), lambda x: x["quota"] > 0)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), some(True).alias("urn")), F.struct((F.col("shard") * 2 + 1).alias("shard"), some(False).alias("urn")))
        node = cut.select("grp", F.explode(halves).alias("h")).select("grp", "h.*").where(F.size("urn") > 0)
    return node.select("shard", F.explode("urn").alias("u")).select("shard", "u.item", F.col("u.quota").alias("n")), lefts


def ranked_blocks(dealt: DataFrame, seed: int) -> DataFrame:
    """(source, block, block_size, source_size, target, n_blocks, rank, before): places in the source's permutation, and the words before it.

    A part of the permutation is ranked by itself, after the sums of the parts before it, so that no task holds all blocks of a source.
    """
    turn = F.xxhash64(F.lit(seed), "source", "block")
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    blocks = materialize(blocks.withColumn("turn", turn).withColumn("part", F.call_function("shiftright", F.col("turn"), F.lit(64 - PARTS_LOG2))), "mix-blocks")
    parts = blocks.groupBy("source", "part").agg(F.sum("block_size").alias("words"), F.count("*").alias("n"))
    upto = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.sum("n").over(W.partitionBy("source")).alias("n_blocks"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("bigint").alias(f"{c}_before") for c in ("words", "n")])
    both = blocks.join(materialize(parts, "mix-parts"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    order = W.partitionBy("source", "part").orderBy("turn", "block")
    rank = F.col("n_before") + F.row_number().over(order) - 1
    before = F.col("words_before") + F.sum("block_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("block_size")
    return both.select("source", "block", "block_size", "source_size", "target", "n_blocks", rank.cast("bigint").alias("rank"), before.cast("bigint").alias("before"))


def edge_rows(rows: DataFrame, cut: bool, seed: int) -> DataFrame:
    """Of the blocks at the edges of targets (about BLOCK documents each), words of whole documents that fit into need.

    Documents are taken in a keyed order as long as they fit, then the others from the longest down where they still do; at last the
    smallest that is left gives the words that are missing (cut), or is taken in whole if that brings the sum nearer. Of TRIALS
    orders that come nearest, the first counts; there is one such block a source.
    """
    keys, zero = ["source", "block", "pass", "shard", "need"], F.lit(0).cast("bigint")
    held = rows.groupBy(*keys).agg(F.collect_list(F.struct("doc_id", "size", "source_size", "target")).alias("held"))
    tried = held.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(0 if cut else TRIALS - 1))))
    turned = F.transform("held", lambda x: F.struct(F.xxhash64(F.lit(seed), F.col("trial"), x["doc_id"]).alias("turn"), *[x[c].alias(c) for c in ("doc_id", "size", "source_size", "target")]))
    blocks = tried.withColumn("all", F.array_sort(turned)).drop("held")

    def ahead(a: Column, x: Column) -> Column:
        fits = a["open"] & (x["size"] <= a["need"])
        return F.struct((a["need"] - F.when(fits, x["size"]).otherwise(zero)).alias("need"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), fits.alias("open"))

    first = F.aggregate("all", F.struct(F.col("need").alias("need"), F.lit(0).alias("n"), F.lit(True).alias("open")), ahead)
    done = blocks.withColumn("first", first)
    longest = F.transform(F.slice("all", F.col("first.n") + 1, F.size("all")), lambda x: F.struct((-x["size"]).alias("minus"), x.alias("x")))
    done = done.withColumn("rest", F.transform(F.array_sort(longest), lambda z: z["x"]))
    start = F.struct(F.col("first.need").alias("need"), F.array().cast("array<boolean>").alias("in"))
    fold = F.aggregate("rest", start, lambda a, x: F.struct((a["need"] - F.when(x["size"] <= a["need"], x["size"]).otherwise(zero)).alias("need"), F.concat(a["in"], F.array(x["size"] <= a["need"])).alias("in")))
    done = done.withColumn("fit", fold)
    over = F.array_min(F.filter(F.transform("rest", lambda x, i: F.when(~F.get("fit.in", i), F.struct(x["size"].alias("size"), i.alias("i")))), lambda x: x.isNotNull()))
    extra = F.col("fit.need") if cut else F.when(over["size"] < 2 * F.col("fit.need"), over["size"]).otherwise(0)
    done = done.withColumn("over", over["i"]).withColumn("extra", F.coalesce(extra, F.lit(0)).cast("bigint"))
    best = F.min_by(F.struct("all", "first", "rest", "fit", "over", "extra"), F.struct(F.abs(F.col("fit.need") - F.col("extra")), F.col("trial")))
    done = done.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
    one = lambda x, words: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["source_size"].alias("source_size"), x["target"].alias("target"), words.cast("bigint").alias("words"))
    taken = F.transform(F.slice("all", F.lit(1), F.col("first.n")), lambda x: one(x, x["size"]))
    others = F.transform("rest", lambda x, i: one(x, F.when(F.get("fit.in", i), x["size"]).when(i == F.col("over"), F.col("extra")).otherwise(zero)))
    return done.select("source", "block", "pass", "shard", F.explode(F.concat(taken, others)).alias("x")).select("source", "block", "pass", "shard", "x.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, cut: bool = True, draws: int = SHARD, seed: int = 7) -> DataFrame:
    """The mix of (doc_id, source, size): a row per copy with doc_id, source, size, source_size, target, block, pass, shard, words, place.

    `words` is the document's size in a copy that a shard draws (with cut, one document at the edge of each target gives its leading
    words only; else a source's words miss the target by up to half that document), `place` the copy's place in its shard (from 1). A
    document that no shard draws has a row with words 0 and place null, so that every input row is accounted for. doc_id is
    whatever identifies a row, a struct perhaps; rows that are equal in all three columns are separate documents. Null sources are
    a source of their own, a null size counts as 0, a document may be of any size. Empty tables give an empty mix; extra columns are ignored.
    Results depend on the rows alone, not on their order or partitions.
    """
    whole = lambda c: c.cast("bigint")
    docs = docs.select("doc_id", "source", whole(F.coalesce("size", F.lit(0))).alias("size"))
    per_source = docs.groupBy("source").agg(whole(F.sum("size")).alias("source_size"), F.count("*").alias("n_docs"))
    goal = materialize(targets(per_source, weights, share, most), "mix-targets").withColumnRenamed("source", "g_source")
    n_blocks = whole(F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)))
    dealt = docs.join(goal, docs["source"].eqNullSafe(F.col("g_source"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n_blocks))
    dealt = materialize(dealt.select("doc_id", "source", "size", "source_size", "target", "block"), "mix-docs")
    rounds = F.when(F.col("source_size") > 0, whole(F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("bigint"))
    blocks = ranked_blocks(dealt, seed + 1).withColumn("rounds", rounds).withColumn("need", whole(F.round("target")) - F.col("rounds") * F.col("source_size") - F.col("before"))
    blocks = blocks.withColumn("times", F.col("rounds") + F.when(F.col("need") > 0, 1).otherwise(0))
    blocks = materialize(blocks.select("source", "block", "rank", "n_blocks", "rounds", "times", "need", "block_size"), "mix-ranks")
    quotas = materialize(blocks.groupBy("source").agg(whole(F.sum("times")).alias("quota")), "mix-quotas")
    all_draws = quotas.agg(F.sum("quota")).first()[0] or 0
    plan = split_tree(quotas, max(0, math.ceil(math.log2(max(1, all_draws / draws)))), seed + 2).where("n > 0")
    drawn = plan.select("shard", F.col("source").alias("p_source"), F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("p_draw"))
    passes = blocks.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    passes = passes.withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("rank"))  # the last pass takes the first blocks of the permutation: no gap
    at = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("draw") == F.col("p_draw"))
    edge = (F.col("pass") == F.col("rounds")) & (F.col("need") < F.col("block_size"))
    placed = materialize(passes.join(drawn, at).select(F.col("source").alias("d_source"), F.col("block").alias("d_block"), "pass", "shard", F.when(edge, F.col("need")).alias("need")), "mix-draws")
    rows = dealt.join(placed, dealt["source"].eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left").drop("d_source", "d_block")
    plain = rows.where("need is null").withColumn("words", F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(0)).drop("need")
    taken = plain.unionByName(edge_rows(rows.where("need is not null"), cut, seed + 3))
    taken = materialize(taken.withColumn("turn", F.xxhash64(F.lit(seed + 4), "shard", "source", "doc_id", "pass")), "mix-copies")
    local = F.row_number().over(W.partitionBy("shard").orderBy("turn", "source", "doc_id", "pass"))
    return taken.where("words > 0").withColumn("place", local).unionByName(taken.where("words = 0").withColumn("place", F.lit(None).cast("int"))).drop("turn")


def row_keys(docs: DataFrame, digest: Column) -> DataFrame:
    """docs to (doc_id: a struct of doc_id, digest and number that names each row by its content, source, size in words); rows of equal id, digest, source and size are numbered."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), "source", size.alias("size"))
    equal = slim.groupBy("id", "digest", "source", "size").agg(F.count("*").alias("n"))  # added up before the shuffle
    return equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(F.struct("id", "digest", "copy").alias("doc_id"), "source", "size")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, and the shards and places of its copies."""
    out = mix(materialize(row_keys(table(spark, sf_dir, "documents"), F.xxhash64("text")), "mix-sizes"))
    copies = F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.struct("shard", "place"))))
    rows = out.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken"), copies.alias("copies"))
    return rows.select("doc_id.id", "size", "source_size", "target", "taken", "copies").withColumnRenamed("id", "doc_id")
