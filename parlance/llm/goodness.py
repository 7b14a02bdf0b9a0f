"""Quality by compression: dictionaries of good and of bad labelled text, and how much better one of them compresses a document.

A text is compressed with either raw-content dictionary. The difference of the two sizes, divided by the larger one, says which it is
like; the smaller size by the length of the text says how far it repeats itself, which no dictionary can tell. A logistic
curve through labelled documents that are in neither dictionary makes a probability of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import in_batches, materialize, reserve, table

#: Of each class (good, bad) at most SAMPLE labelled documents, those with the least hash of id and text, give a dictionary of at most
#: DICTIONARY bytes (half of the documents where a class has fewer than twice as many), and at most CALIBRATED others the curve.
SAMPLE, CALIBRATED, DICTIONARY = 512, 2048, 131_072
#: Of a sampled document at most this many characters, from its middle, go to the dictionary.
EXCERPT = 4096
LEVEL, BLOCK = 9, 32_768


@dataclass(frozen=True)
class Model:
    """dictionaries: of good and bad text, or None where a class has no labelled text; then every score is `prior`."""

    dictionaries: tuple[bytes, bytes] | None
    prior: float
    weights: tuple[float, ...] = ()


class Sizes:
    """Features of a text: bias, normalised difference of the compressed sizes, log ratio of compressed to plain size, its square, log length (up to BLOCK)."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard as z

        self.coders = []
        for d in dictionaries:
            held = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[float, ...]:
        raw = (text or "").encode()
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        ratio = math.log((min(good, bad) + 8) / (len(raw) + 16))
        return 1.0, 10 * (bad - good) / max(good, bad), ratio, ratio * ratio, math.log(min(len(raw), BLOCK) + 16) / 5


def curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps, with a unit penalty on all but the bias."""
    w, penalty = np.zeros(x.shape[1]), np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = probability(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (p - good)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sampled(ids: DataFrame) -> DataFrame:
    """(s_id, s_digest, good, r, n): of each class the rows (doc_id, digest, good) with the least hash, numbered from 1, and how many
    rows the class has.

    Only hashes below a cut that twice as many rows as are wanted should meet go to the task that numbers a class.
    """
    n = ids.groupBy(F.col("good").alias("n_good")).agg(F.count("*").alias("n"))
    h, most = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 32)), SAMPLE + CALIBRATED
    few = ids.join(F.broadcast(n), F.col("good") == F.col("n_good")).withColumn("h", h).where(F.col("h") * F.col("n") < F.lit(2.0 * most * (1 << 32)))  # n: two rows
    few = few.withColumn("r", F.row_number().over(W.partitionBy("good").orderBy("h", "doc_id", "digest"))).where(F.col("r") <= most)
    return few.select(F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest"), "good", "r", "n")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (l_id, a document's id; good, boolean).

    Labels that are null or of no document, and null or empty texts, teach nothing. Repeated rows count once; a document labelled both
    ways counts in both classes. Ties go by id, then text. Labels meet digests of texts, and texts only the bounded sample, so no
    text is shuffled but the sample's. Only the excerpts for the dictionaries and the features of the calibration sample reach
    the driver, both of the size that the constants above bound.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
    known = labels.select("l_id", "good").where("good is not null").distinct()
    ids = rows.select("doc_id", F.xxhash64("text").alias("digest")).join(known, F.col("doc_id") == F.col("l_id")).select("doc_id", "digest", "good").distinct()
    picked = materialize(sampled(materialize(ids, "quality-ids")), "quality-sample")
    counts = {r.good: r.n for r in picked.select("good", "n").distinct().collect()}
    if len(counts) < 2:
        return Model(None, float(next(iter(counts))) if counts else 0.5)
    prior = counts[True] / (counts[True] + counts[False])
    in_dictionary = F.col("r") <= F.least(F.lit(SAMPLE), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    same = (F.col("doc_id") == F.col("s_id")) & (F.xxhash64("text") == F.col("s_digest"))
    texts = rows.join(F.broadcast(picked), same).drop("doc_id", "s_digest").dropDuplicates(["s_id", "good", "r"])  # 2 * (SAMPLE + CALIBRATED) rows
    texts = materialize(texts.withColumn("in_dictionary", in_dictionary), "quality-texts")
    middle = F.substr("text", F.greatest(F.lit(1), F.floor((F.length("text") - EXCERPT) / 2) + 1).cast("int"), F.lit(EXCERPT))
    by: dict[bool, list[bytes]] = {True: [], False: []}
    for r in sorted(texts.where("in_dictionary").select("good", "r", middle.alias("text")).collect(), key=lambda r: r.r):
        by[r.good].append(r.text.encode())
    dictionaries = (_dictionary(by[True]), _dictionary(by[False]))
    rest = _measured(texts.where("not in_dictionary").select("good", "text"), dictionaries).select("good", "x").collect()
    if len({r.good for r in rest}) < 2:
        rest = _measured(texts.select("good", "text"), dictionaries).select("good", "x").collect()
    good = np.array([r.good for r in rest], float)
    n_good = good.sum()
    weight = np.where(good == 1, prior / n_good, (1 - prior) / (len(good) - n_good)) * len(good)  # classes count as in all rows
    return Model(dictionaries, prior, tuple(curve(np.array([r.x for r in rest]), good, weight).tolist()))


def _dictionary(parts: list[bytes]) -> bytes:
    share = max(1, DICTIONARY // len(parts))
    cut = [max(0, (len(p) - share) // 2) for p in parts]
    return b"\n".join([*[p[:c] + p[c + share :] for p, c in zip(parts, cut, strict=True)], *[p[c : c + share] for p, c in zip(parts, cut, strict=True)]])[-DICTIONARY:]


def _measured(df: DataFrame, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    """Adds x, the features of the text column."""
    held, at = df.sparkSession.sparkContext.broadcast(dictionaries), df.columns.index("text")  # 2 * DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sizes(t.as_py()) for t in b.column(at)], pa.list_(pa.float64()))], names=[*b.schema.names, "x"])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1, higher is better) to a table with a text column, whose other columns it leaves alone.

    Whole texts of any length count, in blocks. A null text is scored as an empty one, whose score is the curve's at length zero.
    Repeated rows have equal scores; an empty table gives an empty one; extra columns stay, but x and score are an error. If the
    labels held one class only, every score is 1 or 0 accordingly, and 0.5 without any label.
    """
    reserve(docs, "x", "score")
    if model.dictionaries is None:
        return docs.withColumn("score", F.lit(model.prior))
    x = F.col("x")
    z = sum((x[i] * w for i, w in enumerate(model.weights)), F.lit(0.0))
    return _measured(docs, model.dictionaries).withColumn("score", 1 / (1 + F.exp(F.least(F.greatest(-z, F.lit(-500.0)), F.lit(500.0))))).drop("x")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op12_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learnt from labels.quality outside the held-out fold. A label other than 0 or 1 teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).where("quality in (0, 1)").select(F.col("doc_id").alias("l_id"), (F.col("quality") == 1).alias("good"))
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
