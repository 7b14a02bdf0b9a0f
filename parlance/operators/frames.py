"""Frames of turns and episodes: joins with side tables, pins, populations and filters."""

from __future__ import annotations

import difflib
import warnings
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def checked_columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    """The projection, or an error that names what was probably meant. None is all; an empty list is an error."""
    if columns is None:
        return df.columns
    if not columns:
        raise ValueError("no columns asked for")
    for c in columns:
        if c not in df.columns:
            close = difflib.get_close_matches(c, df.columns, 1)
            raise ValueError(f"no column {c!r}" + (f"; did you mean {close[0]!r}?" if close else ""))
    return columns


def of_files(df: DataFrame, files: list[str]) -> DataFrame:
    """Rows that come from some of the files behind df, by name or path, through whatever filters and renames df holds.

    A folder stands for the files below it: by its path, or by a name that ends in .parquet, as Spark writes a table.
    Spark prunes the files before it reads. A frame whose rows are not rows of files (sums, joins) has no such parts and is an error.
    """
    wanted = sorted({y for f in files for x in (f, unquote(f), quote(unquote(f), safe=":/=+")) for y in (x, x.replace(":///", ":/"))})  # a path as Spark may spell it
    if not wanted:
        return df.limit(0)
    path = F.col("_metadata.file_path")
    met = path.isin(*wanted) if any("/" in f for f in files) else F.col("_metadata.file_name").isin(*wanted)
    for w in wanted:
        if "/" in w or w.endswith(".parquet"):
            met = met | (path.startswith(w.rstrip("/") + "/") if "/" in w else path.contains(f"/{w}/"))
    return df.where(met)


def guard(df: DataFrame, bytes_per_row: int, most: int = 8 << 30, warn: int = 2 << 30, allow_large: bool = False) -> DataFrame:
    """For results that are to be collected: an error if rows times width is above `most`, a warning above `warn`."""
    size = (n := df.count()) * bytes_per_row
    if size > most and not allow_large:
        raise MemoryError(f"{n} rows would take about {size >> 20} MB on the driver; keep the frame distributed, or pass allow_large=True")
    if size > warn:
        warnings.warn(f"{n} rows will take about {size >> 20} MB on the driver", ResourceWarning, stacklevel=2)
    return df


def in_turn_order(turns: DataFrame) -> DataFrame:
    """By episode, start and number, as far as the columns are there."""
    keys = [c for c in ("episode_id", "start_time", "turn_count") if c in turns.columns]
    return turns.orderBy(*keys) if keys else turns


def pin(df: DataFrame, shows: DataFrame, key: str = "podcast_id") -> DataFrame:
    """Only rows of the given shows; unknown ids have no effect."""
    return df.join(shows.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, shows: DataFrame, key: str = "podcast_id") -> DataFrame:
    return df.join(shows.select(key).distinct(), key, "left_anti")


def union_ids(tables: list[DataFrame], key: str = "podcast_id") -> DataFrame:
    """Different ids of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def strict_turns(turns: DataFrame) -> DataFrame:
    """The population of the object model: text that is not blank and a positive span."""
    return turns.where((F.trim("turn_text") != "") & (F.col("end_time") > F.col("start_time")))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def left_join_side(left: DataFrame, side: DataFrame, keys: list[str], order: list | None = None, suffix: str = "_metrics") -> DataFrame:
    """left with the columns of side, of which one row per key is taken; clashing names get the suffix, and no row of left is lost or doubled."""
    one = keep_first(side, keys, order) if order else side.dropDuplicates(keys)
    clash = {c: c + suffix for c in one.columns if c in left.columns and c not in keys}
    return left.join(one.withColumnsRenamed(clash), keys, "left")


def add_speaker_columns(turns: DataFrame) -> DataFrame:
    """n_speakers, is_overlapping, primary_speaker; is_host, is_guest, has_inferred_role; has_inferred_speaker, as far as sources exist."""
    out = turns
    if "speaker" in turns.columns:
        out = out.withColumn("n_speakers", X.n_speakers(F.col("speaker"))).withColumn("is_overlapping", F.col("n_speakers") > 1).withColumn("primary_speaker", X.primary_speaker(F.col("speaker")))
    if "role" in turns.columns:
        out = out.withColumn("is_host", F.coalesce(F.col("role") == "host", F.lit(False))).withColumn("is_guest", F.coalesce(F.col("role") == "guest", F.lit(False))).withColumn("has_inferred_role", ~X.is_placeholder(F.col("role")))
    if "speaker_name" in turns.columns:
        out = out.withColumn("has_inferred_speaker", ~X.is_placeholder(F.col("speaker_name")))
    return out


def in_time_range(turns: DataFrame, start: float, end: float, behavior: str = "strict") -> DataFrame:
    """Turns inside [start, end] (strict), or overlapping it (partial, full). trimmed_start/_end clip only for partial."""
    if behavior not in ("strict", "partial", "full"):
        raise ValueError(f"unknown behavior {behavior!r}")
    s, e = F.lit(max(0.0, start)), F.lit(float(end))
    st, et = F.col("start_time"), F.col("end_time")
    met: Column = (st >= s) & (et <= e) if behavior == "strict" else X.overlaps(st, et, s, e)
    clip = behavior == "partial"
    out = turns.where(met).withColumn("trimmed_start", F.greatest(st, s) if clip else st).withColumn("trimmed_end", F.least(et, e) if clip else et)
    return out.withColumn("was_trimmed", (F.col("trimmed_start") != st) | (F.col("trimmed_end") != et))


def by_speaker(turns: DataFrame, name: str) -> DataFrame:
    return turns.where(F.array_contains("speaker", name) | (F.col("speaker_name") == name if "speaker_name" in turns.columns else F.lit(False)))


def by_min_words(turns: DataFrame, n: int) -> DataFrame:
    return turns.where(X.word_count(F.col("turn_text")) >= n)


def aligned_union(tables: list[DataFrame], like: DataFrame) -> DataFrame:
    """Rows of all tables in the columns and types of `like`: missing columns are null, others go."""
    fit = lambda t: t.select(*[(F.col(f.name).cast(f.dataType) if f.name in t.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])
    out = fit(tables[0])
    for t in tables[1:]:
        out = out.unionByName(fit(t))
    return out
