"""Turns built on a stream against those of a batch."""

import random

from pyspark.sql import functions as F

from parlance.streaming.build import turns_of_words

SCHEMA = "episode_id string, pos long, word string, start double, end double, key string, ts timestamp"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for e in range(5):
        who, at = None, e * 3.0
        for pos in range(60):
            if rng.random() < 0.2:
                who = rng.choice(["A", "B", "A+B", None])
            rows.append((f"e{e}", pos, f"w{pos}", at, at + 0.5, who, at))
            at += rng.choice([0.5, 1.0, 4.0])
    whole = spark.createDataFrame([(*r[:6], r[6]) for r in rows], SCHEMA.replace("ts timestamp", "t double")).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    want = sorted(map(tuple, turns_of_words(whole).collect()))
    shuffled = sorted(rows, key=lambda r: r[6] + rng.uniform(0, 9))  # words come up to nine seconds late
    parts = [shuffled[i : i + 40] for i in range(0, len(shuffled), 40)]
    parts[2] = parts[2] + parts[1][:7]  # and some twice
    parts.append([("end", 0, "x", 0.0, 1.0, "A", 100_000.0)])  # time goes on
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(*r[:6], r[6]) for r in part], SCHEMA.replace("ts timestamp", "t double")).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i:02d}"))
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    for i in range(len(parts)):  # one file a batch, in order of time
        name = next(n for n in os.listdir(tmp_path / f"in{i:02d}") if n.endswith(".parquet"))
        shutil.copy(tmp_path / f"in{i:02d}" / name, tmp_path / "in" / f"{i:02d}.parquet")
        os.utime(tmp_path / "in" / f"{i:02d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, first = [], []

    def keep(df, i):
        got = [tuple(r) for r in df.collect()]
        first.append((i, len(got)))
        out.extend(got)

    turns_of_words(stream, "10 seconds", 60_000).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(r for r in out if r[0] != "end") == want and len(want) > 30
    assert sum(n > 0 for _, n in first) > 3  # turns come as they end, not all at last
