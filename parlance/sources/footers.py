"""An index of row groups, made from Parquet footers alone: what is where, and how much, without a scan.

Footers are read in tasks, a few hundred kilobytes a file; no page of data is. The table can be written beside the data and read
again: look-ups then open only the files that may hold a key, and counts add up the footers' own.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose footers a task reads.
PER_TASK = 64


def _open(path: str):
    """A Parquet file by local path or by a URI that Arrow has a file system for (hdfs, s3, gs, abfs)."""
    import pyarrow.parquet as pq

    found, at = _store(path)
    return pq.ParquetFile(at, filesystem=found)


def _store(path: str):
    import pyarrow.fs as fs

    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def row_groups(spark: SparkSession, files: list[str], column: str) -> DataFrame:
    """path, part, row_group, n_rows, bytes, least, greatest (of the column, as text), n_nulls; a row per row group.

    files: as DataFrame.inputFiles gives them, spelt as URIs; path and part are plain.
    least, greatest and n_nulls are null where a file's writer kept no statistics; a column that a file does not have is null in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path in b.column(0).to_pylist():
                meta = _open(path).metadata
                at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == column), None)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = group.column(at).statistics if at is not None else None
                    known = stats is not None and stats.has_min_max
                    least, greatest = (str(stats.min), str(stats.max)) if known else (None, None)
                    n_nulls = group.num_rows if at is None else stats.null_count if stats is not None and stats.has_null_count else None
                    rows.append((path, path.rsplit("/", 1)[-1], g, group.num_rows, group.total_byte_size, least, greatest, n_nulls))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)

    NAMES = ["path", "part", "row_group", "n_rows", "bytes", "least", "greatest", "n_nulls"]
    some = spark.createDataFrame([(unquote(f),) for f in files], "path string").repartition(max(1, -(-len(files) // PER_TASK)))
    return some.mapInArrow(run, "path string, part string, row_group int, n_rows long, bytes long, least string, greatest string, n_nulls long")


def _typed(groups: DataFrame, kind: str) -> DataFrame:
    return groups.withColumns({c: F.col(c).cast(kind) for c in ("least", "greatest")})


def files_with(groups: DataFrame, value, kind: str = "string") -> list[str]:
    """Files that may hold a value of the indexed column, whose type is `kind`: those whose range has it, and those without statistics."""
    v = F.lit(value).cast(kind)
    some = _typed(groups, kind).where(F.col("least").isNull() & ~F.col("n_nulls").eqNullSafe(F.col("n_rows")) | (F.col("least") <= v) & (F.col("greatest") >= v))
    return sorted(r.path for r in some.select("path").distinct().collect())


def lookup(spark: SparkSession, groups: DataFrame, column: str, value, schema) -> DataFrame:
    """Rows of a written table with a value, from the files that may hold it; Spark skips their other row groups by the same ranges."""
    files = files_with(groups, value, schema[column].dataType.simpleString())
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(column) == value)


def total(groups: DataFrame) -> int:
    """Rows of the table."""
    return groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def counts(spark: SparkSession, groups: DataFrame, column: str, schema) -> DataFrame:
    """column, path, part, num_rows: rows of each value in each file.

    A row group with one value is counted by its footer; only files that have others are read, and of these only the column.
    """
    kind = schema[column].dataType.simpleString()
    pure = (F.col("least") == F.col("greatest")) & (F.col("n_nulls") == 0)
    files = groups.groupBy("path").agg(F.min(F.coalesce(pure, F.lit(False))).alias("pure"))
    told = _typed(groups, kind).join(files.where("pure"), "path", "left_semi").groupBy(F.col("least").alias(column), "path", "part").agg(F.sum("n_rows").alias("num_rows"))
    mixed = sorted(r.path for r in files.where("not pure").collect())
    if not mixed:
        return told
    read = spark.read.schema(schema).parquet(*mixed).select(column, _plain(F.col("_metadata.file_path")).alias("path"), _plain(F.col("_metadata.file_name")).alias("part"))
    return told.unionByName(read.groupBy(column, "path", "part").agg(F.count("*").alias("num_rows")))


def _plain(uri):
    """A path as it is spelt outside of URIs; plus signs stay, which url_decode takes for spaces."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def part_name(path: Column) -> Column:
    """The part that a file is of: the first folder on its path that is named *.parquet, as Spark writes a table; else the file itself."""
    folder = F.regexp_extract(path, r"/([^/]+\.parquet)/", 1)
    return F.when(folder != "", folder).otherwise(F.substring_index(path, "/", -1))


def coverage(groups: DataFrame, parts: list[str]) -> DataFrame:
    """part, n_rows, n_groups, bytes, there: what the named files hold; files that are missing have zeros."""
    wanted = groups.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(parts)], "w_part string")
    have = groups.groupBy("part").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_groups"), F.sum("bytes").alias("bytes"))
    out = wanted.join(have, F.col("w_part") == F.col("part"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("w_part").alias("part"), zero("n_rows"), zero("n_groups"), zero("bytes"), F.col("part").isNotNull().alias("there"))


def rename_columns(spark: SparkSession, files: list[str], target: str, names: dict[str, str], root: str | None = None) -> DataFrame:
    """Files again under other column names, row group by row group: path, n_groups, n_rows of what was written.

    A file below the folder `root` keeps its path below it, so partition folders stay; others keep their name.

    Each file is copied by one task with a row group in memory at a time; its row groups, their order and its compression stay.
    A file is written under another name first and renamed when whole, so a task that runs again does no harm. target is a local or
    shared folder, or a URI that Arrow has a file system for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.parquet as pq

        store, folder = _store(target)
        top = _store(root)[1].rstrip("/") + "/" if root else None
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                source = _open(path)
                meta = source.metadata
                schema = source.schema_arrow
                schema = pa.schema([f.with_name(names.get(f.name, f.name)) for f in schema])
                codec = meta.row_group(0).column(0).compression if meta.num_row_groups else "ZSTD"
                plain = _store(path)[1]
                final = f"{folder}/{plain.removeprefix(top) if top and plain.startswith(top) else plain.rsplit('/', 1)[-1]}"
                inside = final.rsplit("/", 1)[0]
                store.create_dir(inside, recursive=True)
                out = f"{inside}/.{uuid.uuid4().hex}"
                with pq.ParquetWriter(out, schema, filesystem=store, compression=codec) as writer:
                    for g in range(meta.num_row_groups):
                        t = source.read_row_group(g)
                        writer.write_table(t.rename_columns([names.get(c, c) for c in t.column_names]).cast(schema), row_group_size=max(1, t.num_rows))
                store.move(out, final)
                rows.append((final, meta.num_row_groups, meta.num_rows))
            kinds = (pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "n_groups", "n_rows"])

    some = spark.createDataFrame([(unquote(f),) for f in files], "path string").repartition(max(1, len(files)))
    return some.mapInArrow(run, "path string, n_groups int, n_rows long")
