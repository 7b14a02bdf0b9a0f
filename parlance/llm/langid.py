"""Language identification by compression: the language whose text, as a zstandard raw-content dictionary, helps most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import in_batches, materialize, reserve, table

#: The classifier is fitted on at most SAMPLE labelled documents per language (those with the least keyed hash of their id),
#: of which DICTIONARY bytes are kept; at most LANGUAGES languages, so that what is broadcast is at most 8 MB.
SAMPLE, DICTIONARY, LANGUAGES = 64, 32_768, 256
#: Parts of a language that are sampled by themselves first, so that no task reads candidates from all others.
SALTS = 64
LEVEL, BLOCK = 5, 32_768
#: A document is accepted if the second best language's encoding is longer by at least this share.
MARGIN = 0.004


_PLAIN = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))


def letters(text: str) -> bytes:
    """What is compressed: lower case, each run of ASCII characters other than letters as one space."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from (doc_id, text, lang); rows with a null lang or text teach nothing. Repeated rows count once, ties go by id, then text."""
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select("lang", "doc_id", F.xxhash64("text").alias("digest"), "text")
    ids = rows.select("lang", "doc_id", "digest").distinct().withColumn("h", F.xxhash64("doc_id"))  # repeated rows are combined before the shuffle
    order = ["h", "doc_id", "digest"]
    few = ids.withColumn("salt", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= SAMPLE)
    picked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= SAMPLE)  # of SALTS * SAMPLE rows at most
    picked = materialize(picked.select(F.col("lang").alias("p_lang"), F.col("doc_id").alias("p_id"), F.col("digest").alias("p_digest"), "h"), "language-sample")
    if picked.agg(F.count_distinct("p_lang")).first()[0] > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    same = (F.col("lang") == F.col("p_lang")) & F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("digest") == F.col("p_digest"))
    texts = rows.join(F.broadcast(picked), same).select("lang", "h", "doc_id", "digest", F.substr("text", F.lit(1), F.lit(DICTIONARY)).alias("text"))  # SAMPLE rows a language
    sample = texts.dropDuplicates(["lang", "doc_id", "digest"]).collect()
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"], r["digest"])):
        by.setdefault(r["lang"], []).append(letters(r["text"]))
    share = lambda parts: max(1, DICTIONARY // len(parts))
    return {k: b"\n".join([*[p[: share(v)] for p in v], *[p[share(v) :] for p in v]])[:DICTIONARY] for k, v in by.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = sorted(dictionaries)
        self.coders = []
        for k in self.names:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.plain = z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: by how large a share the second best language's encoding is longer. The whole text counts, in blocks."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        raw = letters(text)
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.coders]
        if len(sizes) == 1:
            sizes.append(max(sizes[0], sum(len(self.plain.compress(p)) for p in parts)))
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and accepted to a table with a text column, whose other columns it leaves alone.

    Null texts, and those without a letter, are `und` with score 0 and not accepted; ties go to the first language by name. Whole texts
    of any length are encoded, in blocks. Repeated rows have equal results; an empty table gives an empty one; extra columns stay, but
    lang_pred, score and accepted are an error. Without a dictionary every text is `und`.
    """
    reserve(docs, "lang_pred", "score", "accepted")
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most LANGUAGES * DICTIONARY bytes
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Classifier(held.value)
        for b in batches:
            found = [tell(t.as_py()) for t in b.column(at)]
            names, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n != "und" and s >= MARGIN for n, s in found])], names=[*b.schema.names, "lang_pred", "score", "accepted"])

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return in_batches(docs, run, out)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learnt from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    known = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    found = identify(docs.select("doc_id", "text"), known).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
