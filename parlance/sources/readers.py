"""Readers and writers of the ingest formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import footers, snapshots


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that do not parse are skipped; gzip is read as it is."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Speaker segments: file, start, end, label; lines of fewer than 8 fields or of another type are dropped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.col("f")[3].try_cast("double"), F.col("f")[4].try_cast("double")
    return rows.select(F.col("f")[1].alias("file"), start.alias("start"), (start + length).alias("end"), F.col("f")[7].alias("label")).where("start is not null and end is not null")


def read_words(spark: SparkSession, path: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Timed words (word, start, end and features) from CSV; inverted bounds are swapped, rows without bounds dropped.

    Fields are read as text and cast one by one, so that a feature that is no number costs that value and not the row.
    """
    fields = ["word", "start", "end", *features]
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in fields)).csv(path, header=True, mode="PERMISSIVE")
    rows = rows.select("word", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in fields[1:]])
    return rows.where("start is not null and end is not null").withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})


def read_paths(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """A listing of paths to key (file name without suffix) and path; of equal keys the one listed first stands.

    Lines are read in splits; a line's place is its file, its split's start, and its number in the task that reads the split.
    """
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.text(path).select(at.alias("line"), F.trim("value").alias("path")).where(F.col("path").endswith(suffix))
    key = F.regexp_replace(F.substring_index("path", "/", -1), suffix.replace(".", r"\.") + "$", "")
    return rows.groupBy(key.alias("key")).agg(F.min_by("path", "line").alias("path"))


def rename_columns(spark: SparkSession, source: str, target: str, names: dict[str, str]) -> None:
    """A written tree again under other column names; files, their row groups and compression stay as they are."""
    footers.rename_columns(spark, spark.read.parquet(source).inputFiles(), target, names, source).count()


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """A written tree again in fewer files."""
    spark.read.parquet(source).coalesce(files).write.option("compression", "zstd").mode("overwrite").parquet(target)


def write_shows(df: DataFrame, path: str, key: str = "podcast_id") -> None:
    """A folder per show: for corpora of few shows; write_tree suits others."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def write_row_map(trees: dict[str, DataFrame], path: str) -> None:
    """row_map, written: a file per tree."""
    row_map(trees).repartition("tree").sortWithinPartitions("podcast_id").write.mode("overwrite").partitionBy("tree").parquet(path)


def write_table(df: DataFrame, path: str) -> int:
    """The rows as the table's next version; readers see the old one whole until the new one is."""
    return snapshots.commit(df, path)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return snapshots.read(spark, path, version)


def write_tree(df: DataFrame, path: str, keys: list[str], parts: int, rows_per_file: int = 2_000_000) -> None:
    """Parts in key order, so that row-group statistics prune look-ups; no folder per key."""
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").mode("overwrite").parquet(path)


def row_map(trees: dict[str, DataFrame], key: str = "podcast_id") -> DataFrame:
    """Rows per tree and show, for audits."""
    out = None
    for name, df in trees.items():
        one = df.groupBy(key).agg(F.count("*").alias("num_rows")).select(F.lit(name).alias("tree"), key, "num_rows")
        out = one if out is None else out.unionByName(one)
    return out


def shard_map(trees: dict[str, DataFrame], key: str = "podcast_id", folders: bool = False) -> DataFrame:
    """podcast_id, tree, part, num_rows: the files of written trees that hold each show; folders: see footers.part_name."""
    out = None
    for name, df in trees.items():
        part = footers.part_name(F.input_file_name()) if folders else F.substring_index(F.input_file_name(), "/", -1)
        one = df.select(key, part.alias("part")).groupBy(key, F.lit(name).alias("tree"), "part").agg(F.count("*").alias("num_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def subset_of(spec) -> tuple[list[str], list[str], list[str]]:
    """Shows (12 hexadecimal digits), episodes (16) and titles of a subset: a list, a dict of lists, or a .json or .txt file of either."""
    import json
    import re

    if isinstance(spec, str):
        with open(spec, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text) if spec.endswith(".json") else [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    if isinstance(spec, dict):
        return tuple(list(spec.get(k, [])) for k in ("podcast_ids", "episode_ids", "titles"))
    shows = [x for x in spec if re.fullmatch("[0-9a-f]{12}", x)]
    episodes = [x for x in spec if re.fullmatch("[0-9a-f]{16}", x)]
    return shows, episodes, [x for x in spec if x not in shows and x not in episodes]
