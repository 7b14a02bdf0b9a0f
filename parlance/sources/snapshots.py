"""Tables in versions: a folder of data and a manifest for each, and one pointer step that makes a version the table.

A commit writes the rows to a folder of their own, then the manifest beside its final name, and last renames it to the version's
number, which fails if that number is taken. Readers take the greatest number, so they see the old version whole or the new one
whole, never a gap; what a crash leaves is a folder that no manifest names. Old versions stay readable until vacuum().
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"v(\d{10})\.json")


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class _Files:
    """The file system that holds a path, as Hadoop sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        return self.hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def publish(self, path: str, target: str) -> bool:
        """One atomic step; False if target is there already."""
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(self.at(path), self.at(target), none)
        except Exception as e:  # Java's, known by its name only
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    found = (_NAME.fullmatch(n) for n in _Files(spark, path).names(f"{path}/_versions"))
    return sorted(int(m[1]) for m in found if m)


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(_Files(spark, path).read(f"{path}/_versions/v{version:010d}.json"))


def write_data(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), options: dict | None = None) -> str:
    """First step of a commit: the rows, in a folder that no version names yet."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).options(**{"compression": "zstd"} | (options or {})).parquet(f"{path}/{name}")
    return name


def publish(spark: SparkSession, path: str, folders: list[str], version: int, schema: str) -> int:
    """Second step: these folders become the given version. Conflict if it exists."""
    files = _Files(spark, path)
    waiting, target = f"{path}/_versions/waiting-{uuid.uuid4().hex}", f"{path}/_versions/v{version:010d}.json"
    files.write(waiting, json.dumps({"version": version, "folders": folders, "schema": schema}))
    if not files.publish(waiting, target):
        files.delete(waiting)
        raise Conflict(f"version {version} of {path} exists already")
    return version


def commit(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), append: bool = False, options: dict | None = None) -> int:
    """The rows as the table's next version, or added to what its last one holds. Returns the version's number. options are the writer's.

    Of two commits at a time the later one gets a Conflict, and its rows are deleted: neither is lost without notice.
    """
    spark, before = df.sparkSession, versions(df.sparkSession, path)
    name = write_data(df, path, partition_by, options)
    kept = manifest(spark, path, before[-1])["folders"] if append and before else []
    try:
        return publish(spark, path, [*kept, name], before[-1] + 1 if before else 0, df.schema.json())
    except Conflict:
        _Files(spark, path).delete(f"{path}/{name}")
        raise


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version, or a given one."""
    from pyspark.sql.types import StructType

    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no version" + (f" {version}" if version is not None else ""))
    of = manifest(spark, path, known[-1] if version is None else version)
    schema = StructType.fromJson(json.loads(of["schema"]))
    parts = [spark.read.schema(schema).parquet(f"{path}/{f}") for f in of["folders"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*schema.fieldNames())


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the last `keep` versions and every folder that none of them names; returns what went.

    Not for use while a commit is writing: its folder has no version yet.
    """
    files, known = _Files(spark, path), versions(spark, path)
    for v in known[:-keep]:
        files.delete(f"{path}/_versions/v{v:010d}.json")
    held = {f for v in known[-keep:] for f in manifest(spark, path, v)["folders"]}
    gone = sorted(n for n in files.names(path) if n.startswith("data-") and n not in held)
    for n in gone:
        files.delete(f"{path}/{n}")
    return gone
