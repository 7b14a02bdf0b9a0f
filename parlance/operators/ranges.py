"""Running values over groups of any size: rows in ranges of (keys, order), each range a task, with what went before carried over.

A plain window gives a whole group to one task. Here a group that spans several ranges is computed range by range; at most one
group spans the border between two ranges, so what is carried is a few rows for each border.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import ensure_checkpoints

RANGE = "__range"


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def in_ranges(df: DataFrame, keys: list[str], order: list[str], hold: Callable[[DataFrame], DataFrame] = _checkpoint, parts: int | None = None) -> DataFrame:
    """df with `__range`, the number of its range in the order of keys and order (ascending, nulls first).

    hold writes the rows, so that a row's range stays what it is: ranges are drawn by sampling. Rows that are equal in keys and order are
    in one range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hold(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None) -> DataFrame:
    """rows of in_ranges with running values within keys, in order.

    sums, xors: of a column over the rows up to this one (nulls count as 0). lags: a column of the row before; null in the
    first. lasts: the last value of a column that is not null, up to the row before. Rows that are equal in order are taken in any order. Null keys are a group.
    """
    sums, xors, lags, lasts, totals, firsts = sums or {}, xors or {}, lags or {}, lasts or {}, totals or {}, firsts or {}
    here = W.partitionBy(RANGE, *keys).orderBy(*order)
    so_far, before = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = {k: F.sum(zero(c)).over(so_far) for k, c in sums.items()} | {k: F.bit_xor(zero(c)).over(so_far) for k, c in xors.items()}
    own |= {k: F.lag(F.struct(c.alias("v"))).over(here) for k, c in lags.items()} | {k: F.last(c, True).over(before) for k, c in lasts.items()}
    whole_range = here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own |= {k: F.sum(zero(c)).over(whole_range) for k, c in totals.items()} | {k: F.first(c, True).over(whole_range) for k, c in firsts.items()}
    out = rows.withColumns(own)
    spanning = rows.groupBy(*keys).agg(F.min(RANGE).alias("__first"), F.max(RANGE).alias("__to")).where("__first < __to").drop("__first", "__to")  # fewer than there are ranges
    at = F.struct(*order)
    ends = {k: F.sum(zero(c)).alias(k) for k, c in sums.items()} | {k: F.bit_xor(zero(c)).alias(k) for k, c in xors.items()}
    ends |= {k: F.max_by(F.struct(c.alias("v")), at).alias(k) for k, c in lags.items()} | {k: F.max_by(c, F.when(c.isNotNull(), at)).alias(k) for k, c in lasts.items()}
    ends |= {k: F.sum(zero(c)).alias(k) for k, c in totals.items()} | {k: F.min_by(c, F.when(c.isNotNull(), at)).alias(k) for k, c in firsts.items()}
    tails = _meet(rows, spanning, keys).groupBy(RANGE, *keys).agg(*ends.values())
    over = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carry = {k: F.sum(k).over(over) for k in sums} | {k: F.bit_xor(k).over(over) for k in xors} | {k: F.last(k, True).over(over) for k in [*lags, *lasts]}
    all_ = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry |= {k: F.sum(k).over(all_) for k in totals} | {k: F.first(k, True).over(all_) for k in firsts}
    carried = tails.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([RANGE, *keys])], *[c.alias(f"__c_{k}") for k, c in carry.items()])
    on = F.lit(True)
    for i, c in enumerate([RANGE, *keys]):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = out.join(F.broadcast(carried), on, "left")  # at most two rows for each border between ranges and one for each range of a group that fills several
    whole = {k: F.col(k) + zero(F.col(f"__c_{k}")) for k in sums} | {k: F.col(k).bitwiseXOR(zero(F.col(f"__c_{k}"))) for k in xors}
    whole |= {k: F.coalesce(k, f"__c_{k}")["v"] for k in lags} | {k: F.coalesce(k, f"__c_{k}") for k in lasts}
    whole |= {k: F.coalesce(f"__c_{k}", k) for k in [*totals, *firsts]}  # of the whole group where it spans ranges
    return out.withColumns(whole).drop(*[f"__k{i}" for i in range(len(keys) + 1)], *[f"__c_{k}" for k in carry])


def _meet(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    few = few.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(keys)])
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__m{i}"))
    return rows.join(F.broadcast(few), on, "left_semi")
