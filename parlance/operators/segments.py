"""Turns from timed words and speaker segments: interval join, runs of equal speakers, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import RANGE, in_ranges, running


def interval_join(words: DataFrame, segments: DataFrame, group: str, bucket: float) -> DataFrame:
    """Pairs of one group with w_start < s_end and s_start < w_end.

    Both sides are dealt to time buckets of about a segment's length; a pair is kept in the bucket where the later of the two
    begins, so that none comes twice. No group, however long, meets in one task.
    """
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    w = words.withColumn("bucket", spread("w_start", "w_end"))
    s = segments.withColumn("bucket", spread("s_start", "s_end"))
    met = w.join(s, [group, "bucket"]).where("w_start < s_end and s_start < w_end")
    return met.where(F.floor(F.greatest("w_start", "s_start") / bucket) == F.col("bucket")).drop("bucket")


def islands(rows: DataFrame, group: str, order: list, key: str, hot: bool = False) -> DataFrame:
    """Adds run (0-based): rows of equal key one after another. A null key joins the run in progress, a leading one the first keyed run.

    hot: a group may be too large for one task; rows then go by ranges of (group, order), with what a range needs of those before.
    """
    if hot:
        placed = in_ranges(rows, [group], order)
        known = running(placed, [group], order, lasts={"__before": F.col(key)}, firsts={"__first": F.col(key)})
        known = known.withColumn("__k", F.coalesce(key, "__before", "__first")).withColumn("__c", F.coalesce((F.col("__k") != F.coalesce("__before", "__first")).cast("int"), F.lit(0)))
        return running(known, [group], order, sums={"run": F.col("__c")}).withColumn(key, F.col("__k")).drop("__k", "__c", "__before", "__first", RANGE)
    w = W.partitionBy(group).orderBy(*order)
    carried = F.coalesce(F.last(key, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(key, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    out = rows.withColumn("__k", carried)
    out = out.withColumn("__c", F.coalesce((F.col("__k") != F.lag("__k").over(w)).cast("int"), F.lit(0)))
    return out.withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(key, F.col("__k")).drop("__k", "__c")


def build_turns(labelled: DataFrame, group: str, order: list, key: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Turns of words (start, end, word, key): span, text in order, and mean and population deviation of features without NaN."""
    runs = islands(labelled, group, order, key)
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    stats = [x for c in features for x in (F.avg(clean(c)).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(clean(c)), F.lit(0.0)).alias(f"{c}_stdev"))]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("word").alias("__w")))), lambda x: x["__w"]), " ")
    return runs.groupBy(group, F.col("run").alias("turn_count"), key).agg(F.count("*").alias("n_words"), F.min("start").alias("start_time"), F.max("end").alias("end_time"), ordered.alias("turn_text"), *stats)


def spikes_to_intervals(rows: DataFrame, group: str, start: str, clip_end: str) -> DataFrame:
    """end of each start: the next one, or the clip's end."""
    return rows.withColumn("end", F.coalesce(F.lead(start).over(W.partitionBy(group).orderBy(start)), F.col(clip_end)))
