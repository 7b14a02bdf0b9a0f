"""Running values over ranges against plain windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators import segments, windows
from parlance.operators.ranges import RANGE, in_ranges, running


def test_hot_group_over_many_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), ((F.col("id") * 7919) % 3001).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id") * 31 % 100).alias("v"))
    placed = in_ranges(rows, ["k"], ["o"], parts=16)
    assert placed.where("k = 'hot'").select(RANGE).distinct().count() > 4
    got = running(placed, ["k"], ["o"], sums={"s": F.col("v"), "n": F.lit(1)}, xors={"x": F.col("v")}, lags={"before": F.col("v")}, lasts={"known": F.col("v")}, totals={"all": F.col("v")}, firsts={"first": F.col("v")})
    w = W.partitionBy("k").orderBy("o")
    s = w.rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum(F.coalesce("v", F.lit(0))).over(s), "n": F.count("*").over(s), "x": F.bit_xor(F.coalesce("v", F.lit(0))).over(s), "before": F.lag("v").over(w), "known": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)), "all": F.sum(F.coalesce("v", F.lit(0))).over(W.partitionBy("k")), "first": F.first("v", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    cols = ["k", "o", "v", "s", "n", "x", "before", "known", "all", "first"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_empty(spark):
    placed = in_ranges(spark.range(0).select(F.lit("a").alias("k"), "id"), ["k"], ["id"])
    assert running(placed, ["k"], ["id"], sums={"s": F.col("id")}).isEmpty()


def _turns(spark, n=4000):
    t = spark.range(n).select(F.when(F.col("id") % 4 > 0, F.lit(7)).otherwise(F.col("id") % 30).alias("episode_id"), F.col("id").alias("turn_count"), ((F.col("id") * 7919) % 3989 / 4.0).alias("start_time"), F.concat(F.lit("t"), F.col("id")).alias("turn_text"))
    return t.withColumns({"end_time": F.col("start_time") + 1, "speaker": F.array(F.concat(F.lit("s"), F.col("turn_count") % 3)), "role": F.lit("host")})


def test_windows_and_islands_of_an_episode_over_many_tasks(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        t = _turns(spark)
        assert in_ranges(t, ["episode_id"], ["start_time", "turn_count"]).where("episode_id = 7").select(RANGE).distinct().count() > 4
        for partial in (False, True):
            plain, hot = (windows.window_frame(t, 5, 2, partial=partial, hot=h) for h in (False, True))
            assert sorted(map(str, plain.collect())) == sorted(map(str, hot.select(plain.columns).collect()))
        keyed = t.withColumn("key", F.when((F.col("turn_count") * 31 % 17 < 9) & ((F.col("start_time") > 60) | (F.col("episode_id") == 2)), F.floor(F.col("start_time") / 40).cast("string")))
        plain, hot = (segments.islands(keyed, "episode_id", ["start_time", "turn_count"], "key", hot=h) for h in (False, True))
        assert plain.columns == hot.columns and sorted(map(str, plain.collect())) == sorted(map(str, hot.collect()))
        assert plain.select("episode_id", "run").distinct().count() > 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
