"""Conversation windows: by number of turns and by time. Rows find their windows by arithmetic, so one exchange on the group does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import RANGE, in_ranges, running


def _check(size: float, overlap: float) -> None:
    if size <= 0:
        raise ValueError("window size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and below the window size")


def assign_windows(turns: DataFrame, size: int, overlap: int = 0, group: str = "episode_id", partial: bool = False, hot: bool = False) -> DataFrame:
    """A row per (turn, window it is in): adds pos (0-based place in the group), n_windows, window_index, is_overlap.

    hot: a group may be too large for one task; its turns are then numbered range by range.
    """
    _check(size, overlap)
    step = size - overlap
    if hot:
        by = ["start_time", "turn_count"]
        t = running(in_ranges(turns, [group], by), [group], by, sums={"pos": F.lit(1)}, totals={"n": F.lit(1)}).withColumn("pos", F.col("pos") - 1).drop(RANGE)
    else:
        order = W.partitionBy(group).orderBy("start_time", "turn_count")
        t = turns.withColumn("n", F.count("*").over(W.partitionBy(group))).withColumn("pos", F.row_number().over(order) - 1)
    more = F.ceil((F.col("n") - size) / step) if partial else F.expr(f"(n - {size}) div {step}")
    t = t.withColumn("n_windows", F.when(F.col("n") <= size, F.lit(1)).otherwise(more + 1).cast("bigint"))
    t = t.withColumn("lo", F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)).cast("bigint")).withColumn("hi", F.least(F.expr(f"pos div {step}"), F.col("n_windows") - 1))
    t = t.where("lo <= hi").withColumn("window_index", F.explode(F.sequence("lo", "hi")))
    return t.withColumn("is_overlap", (F.col("window_index") > 0) & (F.col("pos") < F.col("window_index") * step + overlap)).drop("n", "lo", "hi")


def window_frame(turns: DataFrame, size: int = 12, overlap: int = 0, group: str = "episode_id", partial: bool = False, separator: str = " ", means: tuple[str, ...] = (), hot: bool = False) -> DataFrame:
    """One row per window: turns, places [start_index, end_index), span, speakers, host and guest turns, ordered text, means of columns."""
    rows = assign_windows(turns, size, overlap, group, partial, hot)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("turn_text", F.lit("")).alias("t")))), lambda x: x["t"]), separator)
    out = rows.groupBy(group, "window_index").agg(
        F.count("*").alias("n_turns"),
        F.min("pos").cast("bigint").alias("start_index"),
        (F.max("pos") + 1).cast("bigint").alias("end_index"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max_by("end_time", "pos").alias("last_end_time"),
        F.size(F.array_distinct(F.flatten(F.collect_list("speaker")))).cast("bigint").alias("n_speakers"),
        F.count_if(F.col("role") == "host").alias("host_turns"),
        F.count_if(F.col("role") == "guest").alias("guest_turns"),
        text.alias("text"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )
    span = out.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn("duration_to_last_turn", F.col("last_end_time") - F.col("start_time"))
    return span.drop("last_end_time")


def episode_windows(turns: DataFrame, size: int, overlap: int = 0, start_index: int = 0, end_index: int | None = None, group: str = "episode_id") -> DataFrame:
    """window_frame of the turns with places [start_index, end_index) in their group, and total_windows, overlap_size.

    A group without turns there is an error where the frame is empty, as asking for windows of nothing is one.
    """
    order = W.partitionBy(group).orderBy("start_time", "turn_count")
    some = turns.withColumn("__p", F.row_number().over(order) - 1).where(F.col("__p") >= start_index)
    some = (some if end_index is None else some.where(F.col("__p") < end_index)).drop("__p")
    if some.isEmpty():
        raise ValueError("no turns to make windows of")
    out = window_frame(some, size, overlap, group)
    total = F.count("*").over(W.partitionBy(group))
    shift = [(F.col(c) + start_index).alias(c) if c in ("start_index", "end_index") else F.col(c) for c in out.columns]
    return out.select(*shift, total.alias("total_windows"), F.lit(overlap).alias("overlap_size"))


def guarded_window_frame(turns: DataFrame, size: int = 12, overlap: int = 0, bytes_per_row: int = 400, allow_large: bool = False, most: int = 8 << 30, **options) -> DataFrame:
    """window_frame for a result that is to be collected: an error if its text would be too much for the driver."""
    _check(size, overlap)
    n = turns.count() * size // (size - overlap)
    if n * bytes_per_row > most and not allow_large:
        raise MemoryError(f"windows of {n} turns would take about {n * bytes_per_row >> 20} MB on the driver; pass allow_large=True or keep them distributed")
    return window_frame(turns, size, overlap, **options)


def window_statistics(turns: DataFrame, size: int, overlap: int = 0, group: str = "episode_id") -> DataFrame:
    """Per group: turns, windows, and the mean window duration estimated as mean turn duration times size."""
    _check(size, overlap)
    per = turns.groupBy(group).agg(F.count("*").alias("n_turns"), F.avg(F.col("end_time") - F.col("start_time")).alias("m"))
    windows = F.when(F.col("n_turns") <= size, F.lit(1)).otherwise(F.expr(f"(n_turns - {size}) div {size - overlap} + 1")).cast("bigint")
    return per.select(group, "n_turns", windows.alias("n_windows"), F.round(F.col("m") * size, 4).alias("avg_window_duration"))


def window_histogram(turns: DataFrame, column: str, size: int, overlap: int = 0, group: str = "episode_id") -> DataFrame:
    """Turns per window and value of a column (a list column counts each element)."""
    rows = assign_windows(turns, size, overlap, group)
    value = F.explode(column) if turns.schema[column].dataType.typeName() == "array" else F.col(column)
    return rows.select(group, "window_index", value.alias("value")).groupBy(group, "window_index", "value").agg(F.count("*").alias("n"))


def assign_time_windows(turns: DataFrame, duration: float, overlap: float = 0.0, group: str = "episode_id") -> DataFrame:
    """A row per (turn, time window it overlaps). Windows are [k * step, k * step + duration); the group ends at its last end_time."""
    _check(duration, overlap)
    step = duration - overlap
    t = turns.withColumn("total", F.max("end_time").over(W.partitionBy(group)))
    t = t.withColumn("n_windows", F.greatest(F.lit(1), F.floor((F.col("total") - duration) / step).cast("bigint") + 1))
    lo = F.greatest(F.lit(0), F.floor((F.col("start_time") - duration) / step) + 1).cast("bigint")
    hi = F.least(F.col("n_windows") - 1, F.ceil(F.col("end_time") / step) - 1).cast("bigint")
    return t.where("start_time < end_time").withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("window_index", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def time_window_frame(turns: DataFrame, duration: float, overlap: float = 0.0, group: str = "episode_id") -> DataFrame:
    """One row per time window, empty ones too: turns in it, words, words a minute, and the largest primary speaker's share of the words."""
    step = duration - overlap
    spine = turns.groupBy(group).agg(F.max("end_time").alias("total"))
    n = F.greatest(F.lit(1), F.floor((F.col("total") - duration) / step).cast("bigint") + 1)
    spine = spine.select(group, "total", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("window_index"))
    rows = assign_time_windows(turns, duration, overlap, group).withColumn("who", F.try_element_at("speaker", F.lit(1)))
    per = rows.groupBy(group, "window_index", "who").agg(F.count("*").alias("n_turns"), F.sum("word_count").alias("words"))
    top = F.max(F.when(F.col("who").isNotNull(), F.col("words")))
    rows = per.groupBy(group, "window_index").agg(F.sum("n_turns").alias("n_turns"), top.alias("top"), F.sum("words").alias("words"))
    out = spine.join(rows, [group, "window_index"], "left")
    ends = F.least(F.col("window_index") * step + duration, F.col("total"))
    words = F.coalesce("words", F.lit(0)).cast("bigint")
    share = F.when(words > 0, F.round(F.coalesce("top", F.lit(0)) / words, 4))
    return out.select(
        group,
        "window_index",
        (F.col("window_index") * step).alias("window_start"),
        ends.alias("window_end"),
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
        words.alias("words"),
        F.round(words * 60 / duration, 4).alias("words_per_minute"),
        share.alias("top_share"),
    )
