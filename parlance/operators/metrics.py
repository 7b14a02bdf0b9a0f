"""Turn and episode metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def turn_metrics(turns: DataFrame, markers: Column | None = None) -> DataFrame:
    """Adds word_count, char_count, words_per_second, gap_from_prev, overlap_with_prev, discourse_marker_count."""
    order = W.partitionBy("episode_id").orderBy(F.coalesce("start_time", F.lit(0.0)), "turn_count").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("end_time") > 0, F.col("end_time")), ignorenulls=True).over(order)
    words = X.word_count(F.col("turn_text")).cast("bigint")
    diff = F.col("start_time") - F.col("prev_end")
    known = F.col("prev_end").isNotNull() & (F.col("start_time") > 0)
    out = turns.withColumn("prev_end", prev).withColumn("word_count", words).withColumn("char_count", F.coalesce(F.length("turn_text"), F.lit(0)).cast("bigint"))
    out = out.withColumn("words_per_second", X.words_per_second(F.col("word_count"), F.col("end_time") - F.col("start_time")))
    out = out.withColumn("gap_from_prev", F.when(known, F.round(F.greatest(diff, F.lit(0.0)), 4))).withColumn("overlap_with_prev", F.when(known, F.round(F.greatest(-diff, F.lit(0.0)), 4)))
    count = X.marker_count(F.col("turn_text")) if markers is None else markers
    return out.withColumn("discourse_marker_count", F.coalesce(count, F.lit(0)).cast("bigint")).drop("prev_end")


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b != 0, F.round(scale * a / b, 4)).otherwise(F.lit(0.0))


def episode_metrics(measured: DataFrame) -> DataFrame:
    """One row per episode from turns with turn_metrics: its sixteen measures and the turns by hosts and guests.

    Roles count by substring, host before guest, except in speaking time, where they count by prefix.
    """
    role, d = F.lower("role"), F.col("end_time") - F.col("start_time")
    host = F.coalesce(role.contains("host"), F.lit(False))
    guest = ~host & F.coalesce(role.contains("guest"), F.lit(False))
    w, spoken = F.col("word_count"), F.when(d > 0, d)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    words = F.sum(w)
    return measured.groupBy("episode_id").agg(
        words.alias("total_word_count"),
        F.count("*").alias("total_turn_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("speaker")))).cast("bigint").alias("unique_speaker_count"),
        F.coalesce(F.round(F.avg(spoken), 4), F.lit(0.0)).alias("avg_turn_duration"),
        F.coalesce(F.round(F.median(spoken), 4), F.lit(0.0)).alias("median_turn_duration"),
        _ratio(words, F.coalesce(F.sum(spoken), F.lit(0.0))).alias("avg_words_per_second"),
        F.count_if(host).alias("host_turn_count"),
        F.count_if(guest).alias("guest_turn_count"),
        _ratio(F.count_if(host), F.count("*")).alias("host_turn_proportion"),
        _ratio(total(host, w), words).alias("host_word_proportion"),
        F.coalesce(F.round(F.avg(F.when(F.col("gap_from_prev") > 0, F.col("gap_from_prev"))), 4), F.lit(0.0)).alias("avg_gap_duration"),
        F.coalesce(F.round(F.sum("overlap_with_prev"), 4), F.lit(0.0)).alias("total_overlap_duration"),
        _ratio(F.sum("discourse_marker_count"), words, 1000).alias("discourse_marker_rate"),
        _ratio(total(host, w), total(F.coalesce(role.startswith("host"), F.lit(False)), spoken)).alias("speaking_rate_host"),
        total(host, w).alias("host_word_count"),
        total(guest, w).alias("guest_word_count"),
        F.sum("discourse_marker_count").alias("discourse_marker_count"),
        _ratio(total(guest, w), total(F.coalesce(role.startswith("guest"), F.lit(False)), spoken)).alias("speaking_rate_guest"),
    )


def turn_statistics(measured: DataFrame) -> DataFrame:
    """Per episode: turns, words, mean duration and mean words."""
    return measured.groupBy("episode_id").agg(F.count("*").alias("n_turns"), F.sum("word_count").alias("words"), F.round(F.avg(F.col("end_time") - F.col("start_time")), 4).alias("avg_duration"), F.round(F.avg("word_count"), 4).alias("avg_words"))


def stored_metrics(measured: DataFrame) -> DataFrame:
    """Turn metrics in the types they are stored in: markers above 32,767 a turn are held as that, which sums over turns never see."""
    kinds = {"word_count": "int", "char_count": "int", "words_per_second": "float", "gap_from_prev": "float", "overlap_with_prev": "float"}
    markers = F.least(F.col("discourse_marker_count"), F.lit(32767)).cast("smallint")
    return measured.select("episode_id", "turn_count", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()], markers.alias("discourse_marker_count"))


def speaker_histogram(turns: DataFrame) -> DataFrame:
    """Turns per episode and label; a turn of several labels counts for each."""
    return turns.select("episode_id", F.explode("speaker").alias("speaker")).groupBy("episode_id", "speaker").agg(F.count("*").alias("n"))


def role_histogram(turns: DataFrame) -> DataFrame:
    return turns.groupBy("episode_id", F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))


def episode_turn_stats(turns: DataFrame) -> DataFrame:
    """Distinct labels, mean duration, and how much of the episode has more than one speaker, by turns and by time."""
    d, many = F.col("end_time") - F.col("start_time"), X.n_speakers(F.col("speaker")) > 1
    return turns.groupBy("episode_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("speaker")))), ",").alias("labels"),
        F.round(F.avg(d), 4).alias("avg_turn_duration"),
        F.round(F.count_if(many) / F.count("*"), 4).alias("overlap_prop_turn_count"),
        _ratio(F.sum(F.when(many, d).otherwise(0)), F.sum(d)).alias("overlap_prop_duration"),
    )


def transitions(turns: DataFrame) -> DataFrame:
    """How often one primary speaker follows another."""
    order = W.partitionBy("episode_id").orderBy("start_time", "turn_count")
    pairs = turns.select("episode_id", "start_time", "turn_count", X.primary_speaker(F.col("speaker")).alias("a")).withColumn("b", F.lead("a").over(order))
    return pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


def dominance(turns: DataFrame) -> DataFrame:
    """Per episode and speaker: turns, time and share of the episode's speaking time."""
    per = turns.select("episode_id", F.explode("speaker").alias("who"), (F.col("end_time") - F.col("start_time")).alias("d")).groupBy("episode_id", "who").agg(F.count("*").alias("turns"), F.sum("d").alias("seconds"))
    return per.withColumn("share", F.round(F.col("seconds") / F.sum("seconds").over(W.partitionBy("episode_id")), 4))


def discourse_profile(measured: DataFrame) -> DataFrame:
    """Per episode: shares of long (over 50 words) and short (10 at most) turns, mean words of hosts and guests."""
    w = F.col("word_count")
    return measured.groupBy("episode_id").agg(
        F.round(F.count_if(w > 50) / F.count("*"), 4).alias("long_share"),
        F.round(F.count_if(w <= 10) / F.count("*"), 4).alias("short_share"),
        F.round(F.avg(F.when(F.col("role") == "host", w)), 4).alias("host_words"),
        F.round(F.avg(F.when(F.col("role") == "guest", w)), 4).alias("guest_words"),
    )
