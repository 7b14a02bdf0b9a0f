"""Tone of texts by a lexicon of weights, with words that turn, strengthen or set off what stands beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words before a weighted one within which a negation turns it and an intensifier counts; how much of an intensifier is left at each distance.
REACH, FADING = 3, (1.0, 0.95, 0.9)
#: What a negation makes of a weight, and a contrast of the weights before and after it.
TURNED, BEFORE, AFTER = -0.74, 0.5, 1.5
KINDS = ("negation", "intensifier", "contrast")


def shifted_tone(texts: DataFrame, lexicon: DataFrame, shifters: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_words (weighted ones), tone: the mean of the words' shifted weights; 0 without any.

    lexicon: word, weight. shifters: word, kind (of KINDS), strength (of an intensifier: what it adds to a weight's size, below 0 for
    one that weakens). A weighted word is strengthened by the intensifiers within REACH words before it, each less the farther away,
    turned if a negation stands there, and halved before a text's last contrast or raised after it. Both lists are the caller's and
    lower case; a word in both counts as each. Of a word listed twice the greatest weight or strength stands. A null or
    empty text has no words and no row.
    """
    words = texts.select(*keys, F.posexplode(F.split(F.lower(text), r"[^\p{L}\p{N}_']+")).alias("__i", "word")).where("word <> ''")
    known = lexicon.groupBy("word").agg(F.max("weight").cast("double").alias("__w"))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    shift = shifters.groupBy("word").agg(of("negation", F.lit(True)).alias("__not"), of("intensifier", F.col("strength").cast("double")).alias("__by"), of("contrast", F.lit(True)).alias("__but"))
    rows = words.join(known, "word", "left").join(shift, "word", "left")
    order = W.partitionBy(*keys).orderBy("__i")
    back = [(F.lag("__not", k).over(order), F.lag("__by", k).over(order)) for k in range(1, REACH + 1)]
    negated = F.coalesce(F.greatest(*[n for n, _ in back]), F.lit(False))
    added = sum((F.coalesce(by, F.lit(0.0)) * f for (_, by), f in zip(back, FADING, strict=True)), F.lit(0.0))
    contrast = F.max(F.when(F.col("__but"), F.col("__i"))).over(W.partitionBy(*keys))
    placed = rows.withColumns({"__negated": negated, "__added": added, "__at": contrast})
    weight = F.col("__w") * F.greatest(1 + F.col("__added"), F.lit(0.0)) * F.when(F.col("__negated"), TURNED).otherwise(1.0)
    weight = weight * F.when(F.col("__i") < F.col("__at"), BEFORE).when(F.col("__i") > F.col("__at"), AFTER).otherwise(1.0)
    return placed.groupBy(*keys).agg(F.count("__w").alias("n_words"), F.round(F.coalesce(F.avg(weight), F.lit(0.0)), 6).alias("tone"))
