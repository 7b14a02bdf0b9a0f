"""Topics of conversation windows by latent Dirichlet allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows


def window_terms(turns: DataFrame, size: int = 12, overlap: int = 3, min_words: int = 120, min_terms: int = 60, group: str = "episode_id", small_talk: tuple[str, ...] = ()) -> DataFrame:
    """group, window_index, terms of whole windows with at least min_words words and min_terms terms.

    Terms are lower-case runs of at least three letters without English stop words and the caller's words of small talk. Groups of fewer than
    `size` turns have no whole window.
    """
    from pyspark.ml.feature import StopWordsRemover

    w = windows.window_frame(turns, size, overlap, group).where((F.col("n_turns") == size) & (F.regexp_count("text", F.lit(r"\S+")) >= min_words))
    stop = sorted({*StopWordsRemover.loadDefaultStopWords("english"), *small_talk})
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)), lambda x: ~x.isin(stop))
    return w.select(group, "window_index", terms.alias("terms")).where(F.size("terms") >= min_terms)


def fit_topics(rows: DataFrame, k: int = 15, vocabulary: int = 20_000, min_df: int = 2, iterations: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with topic weights, keys of each topic); rows: any columns and terms.

    The matrix of k topics times at most `vocabulary` terms is what each task holds, whatever the number of rows. A term in
    fewer than min_df windows is left out.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    counter = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=vocabulary, minDF=min_df).fit(rows)
    counted = counter.transform(rows)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(counted)
    weights = model.transform(counted).withColumn("weights", vector_to_array("topicDistribution")).drop("features", "topicDistribution")
    words = F.lit(counter.vocabulary)
    keys = model.describeTopics(12).select("topic", F.transform("termIndices", lambda i: F.get(words, i)).alias("words"))
    return weights, keys


def main_topic(weights: DataFrame) -> DataFrame:
    """The heaviest topic of each row (the first of equals) and its weight."""
    best = F.array_max("weights")
    return weights.withColumn("topic", (F.array_position("weights", best) - 1).cast("int")).withColumn("weight", best).drop("weights", "terms")
