"""Turns, shows, episodes and intervals as they are derived from the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.readers import table

TOKENS = ("the", "and", "that", "die", "der", "le")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as turns; every time is a multiple of 0.25, so sums are exact."""
    c = table(spark, d, "conversations")
    role = F.when(F.col("role") == "assistant", "host").when(F.col("role") == "user", "guest").otherwise(X.NO_ROLE)
    speaker = F.when(F.col("role") == "system", F.array().cast("array<string>")).when(F.col("turn") % 3 == 2, F.array("role", F.lit("crosstalk"))).otherwise(F.array("role"))
    t = c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("turn_count"), F.col("text").alias("turn_text"), role.alias("role"), speaker.alias("speaker"), X.word_count(F.col("text")).cast("bigint").alias("word_count"))
    t = t.withColumn("duration", F.col("word_count") / 2.0)
    before = F.coalesce(F.sum("duration").over(W.partitionBy("episode_id").orderBy("turn_count").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("start_time", before + F.col("turn_count") * F.when(F.col("turn_count") % 3 == 2, -0.5).otherwise(0.25))
    return t.withColumn("end_time", F.col("start_time") + F.col("duration"))


TURNS = r"""turns AS (
  SELECT *, start_time + duration AS end_time FROM (
    SELECT *, coalesce(sum(duration) OVER (PARTITION BY episode_id ORDER BY turn_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + turn_count * CASE WHEN turn_count % 3 = 2 THEN -0.5::DOUBLE ELSE 0.25::DOUBLE END AS start_time FROM (
      SELECT *, word_count / 2.0::DOUBLE AS duration FROM (
        SELECT conv_id AS episode_id, turn AS turn_count, text AS turn_text,
          CASE role WHEN 'assistant' THEN 'host' WHEN 'user' THEN 'guest' ELSE 'NO_INFERRED_ROLE' END AS role,
          CASE WHEN role = 'system' THEN []::VARCHAR[] WHEN turn % 3 = 2 THEN [role, 'crosstalk'] ELSE [role] END AS speaker,
          len(regexp_extract_all(text, '\S+'))::BIGINT AS word_count FROM conversations))))"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as episodes of a show per source."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("episode_id"), F.col("source").alias("podcast_id"), F.col("n_chars").cast("double").alias("duration_seconds"), "lang", F.col("lang").alias("language"), F.col("lang").alias("category"), (F.col("n_chars") % 4).alias("num_main_speakers"))


EPISODES = "episodes AS (SELECT doc_id AS episode_id, source AS podcast_id, n_chars::DOUBLE AS duration_seconds, lang AS language, lang AS category, n_chars % 4 AS num_main_speakers FROM documents)"


def shows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier")
    return t.select(F.col("s_suppkey").alias("podcast_id"), F.col("s_name").alias("pod_title"))


def appearances(spark: SparkSession, d: str) -> DataFrame:
    """Customers as guests of the suppliers they buy from: the different (guest, podcast_id) of all order lines."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("guest"), F.col("l_suppkey").alias("podcast_id")).distinct()


APPEARANCES = "appearances AS (SELECT DISTINCT o_custkey AS guest, l_suppkey AS podcast_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even events as words of half an hour, odd ones as segments an hour to both sides."""
    t = table(spark, d, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    words = t.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("word_id"), F.col("t").alias("w_start"), (F.col("t") + 1800).alias("w_end"))
    segments = t.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("segment_id"), F.col("event_type").alias("label"), (F.col("t") - 3600).alias("s_start"), (F.col("t") + 3600).alias("s_end"))
    return words, segments


INTERVALS = """words AS (SELECT user_id, event_id AS word_id, floor(epoch(ts)) AS w_start, floor(epoch(ts)) + 1800 AS w_end FROM events WHERE event_id % 2 = 0),
segments AS (SELECT user_id, event_id AS segment_id, event_type AS label, floor(epoch(ts)) - 3600 AS s_start, floor(epoch(ts)) + 3600 AS s_end FROM events WHERE event_id % 2 = 1)"""


def library_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a catalog of episodes with titles, names, dates and categories."""
    t, i = table(spark, d, "documents"), F.col("doc_id")
    guests = F.when(i % 2 == 0, F.array(F.concat(F.lit("Guest "), i % 11), F.concat(F.lit(" guest "), i % 5))).otherwise(F.array().cast("array<string>"))
    return t.select(
        i.alias("episode_id"),
        F.col("source").alias("podcast_id"),
        F.concat(F.lit("Episode "), i % 97).alias("ep_title"),
        F.concat(F.lit("https://cdn.example/a_"), i, F.lit(".mp3")).alias("mp3_url"),
        F.col("n_chars").cast("double").alias("duration_seconds"),
        F.col("lang").alias("language"),
        F.col("lang").alias("category1"),
        F.when(i % 3 == 0, F.lit(" Comedy ")).alias("category2"),
        F.array_compact(F.array("lang", F.when(i % 3 == 0, F.lit("Comedy")))).alias("categories"),
        F.array(F.concat(F.lit("Host "), i % 7)).alias("host_predicted_names"),
        guests.alias("guest_predicted_names"),
        (i % 4).alias("num_main_speakers"),
        (F.lit(1700000000000) + i * 3600000).cast("string").alias("episode_date"),
        ((i % 100) / 100.0).alias("overlap_prop_duration"),
        (i % 5).alias("total_sp_labels"),
    )


LIBRARY = """library AS (SELECT doc_id AS episode_id, source AS podcast_id, 'Episode ' || (doc_id % 97) AS ep_title, 'https://cdn.example/a_' || doc_id || '.mp3' AS mp3_url,
  n_chars::DOUBLE AS duration_seconds, lang AS language, lang AS category1, CASE WHEN doc_id % 3 = 0 THEN ' Comedy ' END AS category2,
  CASE WHEN doc_id % 3 = 0 THEN [lang, 'Comedy'] ELSE [lang] END AS categories, ['Host ' || (doc_id % 7)] AS host_predicted_names,
  CASE WHEN doc_id % 2 = 0 THEN ['Guest ' || (doc_id % 11), ' guest ' || (doc_id % 5)] ELSE []::VARCHAR[] END AS guest_predicted_names, doc_id % 4 AS num_main_speakers,
  (1700000000000 + doc_id * 3600000)::VARCHAR AS episode_date, (doc_id % 100) / 100.0::DOUBLE AS overlap_prop_duration, doc_id % 5 AS total_sp_labels FROM documents)"""


def library_shows(spark: SparkSession, d: str) -> DataFrame:
    """A show per source."""
    s = table(spark, d, "documents").select("source").distinct()
    n = F.length("source")
    return s.select(F.col("source").alias("podcast_id"), F.concat(F.lit("The Show "), "source").alias("pod_title"), F.concat(F.lit("https://Feeds"), n, F.lit(".example/"), "source").alias("rss_url"), F.concat(F.lit("c"), n).alias("primary_category"))


LIBRARY_SHOWS = """shows AS (SELECT DISTINCT source AS podcast_id, 'The Show ' || source AS pod_title, 'https://Feeds' || length(source) || '.example/' || source AS rss_url, 'c' || length(source) AS primary_category FROM documents)"""


def library_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a show, names of some speakers, and tokens of some turns."""
    t = turns(spark, d)
    name = F.when(F.col("role") == "guest", F.concat(F.lit("Guest "), F.col("episode_id") % 11)).when(F.col("role") == "host", F.concat(F.lit("Host "), F.col("episode_id") % 7)).otherwise(X.NO_SPEAKER)
    return t.withColumn("podcast_id", F.concat(F.lit("src"), F.col("episode_id") % 20)).withColumn("speaker_name", name).withColumn("token_count", F.when(F.col("turn_count") % 4 != 3, F.col("word_count")))


LIBRARY_TURNS = """lturns AS (SELECT *, 'src' || (episode_id % 20) AS podcast_id, CASE role WHEN 'guest' THEN 'Guest ' || (episode_id % 11) WHEN 'host' THEN 'Host ' || (episode_id % 7) ELSE 'NO_INFERRED_SPEAKER' END AS speaker_name,
  CASE WHEN turn_count % 4 <> 3 THEN word_count END AS token_count FROM turns)"""
