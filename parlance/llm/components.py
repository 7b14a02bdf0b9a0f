"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _orient(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-star")
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    rest = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _orient(rest.unionByName(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any orderable kind, repeats and loops allowed, to (u, v): each node but the least of its component, with that least node.

    Minima are combined before the shuffle and joined back from written tables, so that Spark can split the rows of a node
    with many edges. Only a count and a checksum per round come to the driver; the number of rounds grows with the
    logarithm of the longest chain.
    """
    now = materialize(_orient(edges), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sign) == seen or sign[0] == 0:
            return now
        seen = tuple(sign)
        now = materialize(_small(materialize(_large(now), "edges")), "edges")
