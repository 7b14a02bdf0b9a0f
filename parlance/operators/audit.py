"""Checks and counts of written tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_turns(turns: DataFrame) -> DataFrame:
    """One row: turns, episodes, turns without tokens, without text, with a span that is not positive, without speakers."""
    return turns.agg(
        F.count("*").alias("n_turns"),
        F.count_distinct("episode_id").alias("n_episodes"),
        F.count_if(F.col("token_count").isNull()).alias("null_tokens"),
        F.count_if(F.trim(F.coalesce("turn_text", F.lit(""))) == "").alias("empty_texts"),
        F.count_if(~(F.col("end_time") > F.col("start_time")) | F.col("start_time").isNull() | F.col("end_time").isNull()).alias("bad_spans"),
        F.count_if(F.size(F.coalesce("speaker", F.array().cast("array<string>"))) == 0).alias("no_speakers"),
    )


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def spread_keys(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Keys whose rows are in several parts, which the layout rules out; empty if the parts are disjoint."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def invalid_rows(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """(rule, n): episodes with a blank title or address or a negative length, and turns that end before they begin."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    e = episodes.agg(F.count_if(blank("ep_title")).alias("blank title"), F.count_if(blank("mp3_url")).alias("blank address"), F.count_if(F.col("duration_seconds") < 0).alias("negative length"))
    t = turns.agg(F.count_if(F.col("end_time") < F.col("start_time")).alias("ends before it begins"))
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in d.columns])).alias("x")).select("x.*")
    return long(e).unionByName(long(t))


def file_sizes(df: DataFrame) -> DataFrame:
    """path, bytes of the files behind a scan, from the file system and not from the data."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for f in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(f)
        rows.append((f, at.getFileSystem(conf).getFileStatus(at).getLen()))
    return spark.createDataFrame(rows, "path string, bytes long")


def manifest(trees: dict[str, DataFrame], version: str) -> str:
    """JSON of the measured rows, shows, episodes, files and bytes of every table."""
    out: dict = {"version": version, "tables": {}}
    for name, df in trees.items():
        keys = [c for c in ("podcast_id", "episode_id") if c in df.columns]
        row = df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(c) for c in keys]).first()
        size = file_sizes(df).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        out["tables"][name] = {"rows": row["rows"], **{c.replace("_id", "s"): row[c] for c in keys}, "files": size["files"], "bytes": size["bytes"]}
    return json.dumps(out, indent=1, sort_keys=True)
