"""From raw documents to packed training sequences: language, near-duplicates, personal data, mixture, packing.

Every stage takes whole texts of any length. Extra columns of its input, whatever their names, are not read and not returned. A table
without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import langid, mixing, packing, pii, similar
from parlance.llm.store import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of the mixture: weights of the sources in turn, words as a share of all, and times a source is taken at most.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or a narrow margin between the two best languages.

    Null and empty texts go, as they have no letters. Documents without a language label are judged like others. Repeated rows share
    their fate, so ties cannot matter; a tie between two languages is a narrow margin.
    """
    known = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.identify(docs.select(*COLUMNS), known).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents joined by a similarity of 0.8 in five-word shingles, the one with the smallest id stays.

    Null, empty and blank texts are one class. Of repeated rows one stays; of different texts with one id that of the least text.
    Rows without an id stay.
    """
    return similar.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format, row by row, by the configured key; n_chars follows where the text changes.

    Null and empty texts stay as they are; repeated rows stay equal.
    """
    out = pii.pseudonymize(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mixture takes, by shard and in the shard's shuffled order; texts are taken whole.

    Documents without words are not taken, so null and empty texts go. A null source is a source of its own. Repeated rows are taken
    like separate documents; rows are known by their content, so neither their order nor their partitions matter.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("d1"), F.xxhash64(F.lit(1), *COLUMNS).alias("d2"))
    sizes = materialize(mixing.row_keys(rows.withColumn("doc_id", F.col("d1")), F.col("d2")), "mix-sizes")
    taken = mixing.mix(sizes, WEIGHTS, SHARE, MOST, False).where("words > 0").select(F.col("doc_id.id").alias("d1"), F.col("doc_id.digest").alias("d2"), "shard", "place")
    once = rows.dropDuplicates(["d1", "d2"])  # equal rows once: each copy that is taken has its own row on the right
    return once.join(taken, ["d1", "d2"]).repartition("shard").sortWithinPartitions("shard", "place").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens and their places in sequences.

    Null and empty texts are a piece of the end token. Rows are packed one by one, so repeated rows and rows with one id have pieces
    of their own; doc_id may be of any type.
    """
    pieces = packing.tokenize(docs.select("doc_id", "text"), *packing.vocabulary())
    return packing.pack(materialize(pieces, "pieces"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packed", packed)]
#: SQL has no compression, no SimHash links and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
