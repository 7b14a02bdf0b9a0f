"""Statistics of measured turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import ensure_checkpoints


def z_scores(rows: DataFrame, by: str, value: str, min_rows: int = 2) -> DataFrame:
    """Value in sample standard deviations from the group's mean, for groups of at least min_rows rows (null values count as rows)."""
    w = W.partitionBy(by)
    out = rows.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= min_rows)
    return out.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))).drop("__n")


def rate_per_day(events: DataFrame, day: Column, hit: Column) -> DataFrame:
    """Hits per event and day."""
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.round(F.count_if(hit) / F.count("*"), 4).alias("rate"))


def paired_delta(rows: DataFrame, by: str, after: Column, value: str) -> DataFrame:
    """Mean after less mean before, of groups that have both."""
    per = rows.groupBy(by).agg(F.avg(F.when(~after, F.col(value))).alias("before"), F.avg(F.when(after, F.col(value))).alias("after"))
    return per.where("before is not null and after is not null").select(by, F.round("before", 4).alias("mean_before"), F.round("after", 4).alias("mean_after"), F.round(F.col("after") - F.col("before"), 4).alias("delta"))


def pillai(rows: DataFrame, group: str, label: str, x: str, y: str) -> DataFrame:
    """Pillai's trace of two classes in two variables, from class means and covariances: trace of H (H + E)^-1."""
    c = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    n, m = F.col("n"), lambda a: F.sum(F.col("n") * F.col(a))
    s = c.groupBy(group).agg(
        F.count("*").alias("k"), F.sum("n").alias("t"), m("mx").alias("sx"), m("my").alias("sy"),
        F.sum(n * F.col("mx") * F.col("mx")).alias("hxx"), F.sum(n * F.col("my") * F.col("my")).alias("hyy"), F.sum(n * F.col("mx") * F.col("my")).alias("hxy"),
        m("vx").alias("exx"), m("vy").alias("eyy"), m("cxy").alias("exy"),
    ).where("k = 2")
    s = s.withColumn("hxx", F.col("hxx") - F.col("sx") * F.col("sx") / F.col("t")).withColumn("hyy", F.col("hyy") - F.col("sy") * F.col("sy") / F.col("t")).withColumn("hxy", F.col("hxy") - F.col("sx") * F.col("sy") / F.col("t"))
    s = s.withColumn("a", F.col("hxx") + F.col("exx")).withColumn("d", F.col("hyy") + F.col("eyy")).withColumn("b", F.col("hxy") + F.col("exy"))
    trace = (F.col("hxx") * F.col("d") - 2 * F.col("hxy") * F.col("b") + F.col("hyy") * F.col("a")) / F.nullif(F.col("a") * F.col("d") - F.col("b") * F.col("b"), F.lit(0.0))
    return s.select(group, F.round(trace, 4).alias("pillai"))


def running_counts(per: DataFrame, value: str, n: str) -> DataFrame:
    """Adds before: the sum of n over smaller values. Values are dealt to ranges; a range's sum of those before it is one number."""
    spark = per.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoints(spark)
    dealt = per.repartitionByRange(parts, value).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("__part").agg(F.sum(n).alias("__sum"))  # a row per partition
    ahead = F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(n).over(W.partitionBy("__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(sums.withColumn("__ahead", ahead).drop("__sum")), "__part").withColumn("before", own + F.col("__ahead")).drop("__part", "__ahead")


def mann_whitney(rows: DataFrame, label: str, value: str) -> DataFrame:
    """U of the rows where label is true, with mean ranks for ties. Ranks come from counts per value, not from the rows."""
    per = rows.groupBy(value).agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("n1"))
    ranked = running_counts(per, value, "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    return ranked.agg((F.sum(F.col("rank") * F.col("n1")) - F.sum("n1") * (F.sum("n1") + 1) / 2).alias("u"), F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"))


def paired_t(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """n, mean difference and t of paired values, of rows that have both."""
    d = F.col(after) - F.col(before)
    out = pairs.where(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return out.select("n", F.round("mean", 6).alias("mean_difference"), F.round(F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)), 6).alias("t"))


def correlations(rows: DataFrame, by: str, x: str, y: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per group: n, correlation of x and y, sample deviation and exact quantiles of x."""
    q = [F.round(F.percentile(x, F.lit(p)), 6).alias(f"q{int(100 * p)}") for p in quantiles]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.corr(x, y), 6).alias("r"), F.round(F.stddev_samp(x), 6).alias("sd"), *q)


def within_and_between(weights: DataFrame, key: str, group: str) -> DataFrame:
    """within (boolean), n, mean cosine of all pairs of documents (a < b) that share a term, by whether they share their group.

    weights: key, group, term, weight of unit length; for the documents of some guests, not for a corpus.
    """
    a = weights.select("term", F.col(key).alias("a"), F.col(group).alias("ga"), F.col("weight").alias("x"))
    b = weights.select("term", F.col(key).alias("b"), F.col(group).alias("gb"), F.col("weight").alias("y"))
    pairs = a.join(b, "term").where("a < b").groupBy("a", "b", (F.col("ga") == F.col("gb")).alias("within")).agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return pairs.groupBy("within").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))


def mean_cosines(weights: DataFrame, key: str, group: str) -> DataFrame:
    """group (null: between groups), n_pairs, mean_cosine over all pairs of documents, those that share no term included.

    From sums of vectors, so no pair is made: |sum of a group|^2 is its squared lengths and twice its pairs' products; what the whole sum
    has beyond the groups' is between them. weights: key, group (one for each document), term, weight of any length. A group
    of one document has no pairs and no row.
    """
    docs = weights.groupBy(F.col(group).alias("__g"), F.col(key).alias("__k")).agg(F.sum(F.col("weight") * F.col("weight")).alias("__own"))
    sizes = docs.groupBy("__g").agg(F.count("*").alias("__n"), F.sum("__own").alias("__own"))
    sums = weights.groupBy(F.col(group).alias("__g"), "term").agg(F.sum("weight").alias("__s"))
    square = sums.groupBy("__g").agg(F.sum(F.col("__s") * F.col("__s")).alias("__square"))
    each = square.withColumnRenamed("__g", "__h").join(sizes, F.col("__g").eqNullSafe(F.col("__h"))).drop("__h")
    n = F.col("__n")
    within = each.where(n > 1).select(F.col("__g").cast("string").alias("group"), (n * (n - 1) / 2).cast("bigint").alias("n_pairs"), ((F.col("__square") - F.col("__own")) / (n * (n - 1))).alias("__m"))
    whole = sums.groupBy("term").agg(F.sum("__s").alias("__s")).agg(F.sum(F.col("__s") * F.col("__s")).alias("__all")).crossJoin(each.agg(F.sum("__square").alias("__in"), F.sum(n).alias("__total"), F.sum(n * n).alias("__nn")))  # a row each
    pairs = (F.col("__total") * F.col("__total") - F.col("__nn")) / 2
    between = whole.where(pairs > 0).select(F.lit(None).cast("string").alias("group"), pairs.cast("bigint").alias("n_pairs"), ((F.col("__all") - F.col("__in")) / (2 * pairs)).alias("__m"))
    return within.unionByName(between).select("group", "n_pairs", F.round("__m", 6).alias("mean_cosine"))


def topic_share(rows: DataFrame, by: str, topic: str, weight: str) -> DataFrame:
    """by, topic, share (mean weight) and relative (to the topic's mean over all groups)."""
    per = rows.groupBy(by, topic).agg(F.avg(weight).alias("m"))
    return per.select(by, topic, F.round("m", 6).alias("share"), F.round(F.col("m") / F.avg("m").over(W.partitionBy(topic)), 6).alias("relative"))
