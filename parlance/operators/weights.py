"""Term weights of documents by blocks: postings stay with their block, and only counts by term travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.session import settled

#: Words of a block, about; a document is in one block.
BLOCK = 1 << 19


def _blocks(docs: DataFrame) -> DataFrame:
    """(key, words), no key in two partitions and keys in order, to rows of blocks.

    A row per block and term: n (keys that have it) and posts (of each its number in the block and tf, as 32-bit numbers); and one of no
    term: n (rows of the block) and keys. What a row has not is empty rather than null, as Spark's Arrow writer goes over all null
    lists of a batch again for each row.
    """

    def put(keys: list, lists: pa.Array, block: int) -> pa.RecordBatch:
        new = np.array([True, *(a != b for a, b in zip(keys, keys[1:]))])
        found = lists.flatten().dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        place = np.repeat(np.cumsum(new) - 1, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        n_keys = int(new.sum())
        empty = pc.index(found.dictionary, "").as_py()
        some = codes != empty
        met, tf = np.unique(codes[some] * n_keys + place[some], return_counts=True)  # by term, then key
        starts = np.flatnonzero(np.append(True, np.diff(met // n_keys) != 0)[: len(met)])
        ends = np.append(starts, len(met)).astype(np.int32)
        posts = np.stack([met % n_keys, tf], axis=1).astype(np.int32)
        places = pa.py_buffer(np.append(ends, ends[-1]) * np.int32(8))
        own = pa.array([*([[]] * len(starts)), [k for k, first in zip(keys, new.tolist(), strict=True) if first]], pa.list_(kind))
        terms = pa.concat_arrays([found.dictionary.take(pa.array(met[starts] // n_keys)).cast(pa.string()), pa.nulls(1, pa.string())])
        counts = pa.array(np.append(np.diff(ends), len(keys)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts) + 1, block)), terms, counts, pa.Array.from_buffers(pa.binary(), len(counts), [None, places, pa.py_buffer(posts)]), own], names=["block", "term", "n", "posts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        lists: list[pa.Array] = []
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy())
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                keys += b.column(0).slice(at, to - at).to_pylist()
                lists.append(b.column(1).slice(at, to - at))
                held += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if held >= BLOCK:
                    cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)  # the last key may go on
                    if cut:
                        whole = pa.concat_arrays(lists)
                        yield put(keys[:cut], whole.slice(0, cut), block)
                        keys, lists, block = keys[cut:], [whole.slice(cut)], block + 1
                        held = int(pc.sum(pc.list_value_length(lists[0])).as_py() or 0)
        if keys:
            yield put(keys, pa.concat_arrays(lists), block)

    kind = to_arrow_type(docs.schema["key"].dataType)
    fields = [("block", T.LongType()), ("term", T.StringType()), ("n", T.LongType()), ("posts", T.BinaryType()), ("keys", T.ArrayType(docs.schema["key"].dataType))]
    return docs.select("key", "words").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _weighted(rows: DataFrame, n_docs: int, key: T.StructField) -> DataFrame:
    """Rows of blocks and, by block and term, df, block after block, to key, term, weight."""

    def put(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(parts).combine_chunks()
        keys = block.filter(pc.is_null(block["term"]))["keys"].combine_chunks().flatten()
        known, own = block.filter(pc.is_valid(block["df"])), block.filter(pc.and_(pc.is_null(block["df"]), pc.is_valid(block["term"])))
        at = pc.index_in(own["term"], known["term"])
        own, at = own.filter(pc.is_valid(at)), pc.drop_null(at)
        size = pc.binary_length(own["posts"]).to_numpy() // 8
        df = np.repeat(known["df"].to_numpy()[at.to_numpy()], size)
        place, tf = np.frombuffer(b"".join(own["posts"].to_pylist()), np.int32).reshape(-1, 2).T
        w = (1 + np.log(tf)) * (np.log((1 + n_docs) / (1 + df)) + 1)
        w /= np.sqrt(np.bincount(place, w * w, len(keys)))[place]
        terms = own["term"].combine_chunks().take(pa.array(np.repeat(np.arange(len(size)), size)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(place)), terms, pa.array(w)], names=[key.name, "term", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            blocks = b.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
            for i, j in zip(ends, ends[1:]):
                if kept and kept[0].column(0)[0].as_py() != blocks[i]:
                    yield put(kept)
                    kept = []
                kept.append(b.slice(i, j - i))
        if kept:
            yield put(kept)

    return rows.select("block", "term", "posts", "keys", "df").mapInArrow(run, T.StructType([key, T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def term_weights(docs: DataFrame, key: str, words, min_df: int) -> DataFrame:
    """key, term, weight with 1 + ln tf, smooth idf and unit length over the terms of `min_df` keys or more; words: a column of lists, '' is none.

    Texts are shuffled into the order of their keys and cut once. Rows of one key are one document, though each counts in the idf. Counts
    by block and term meet by term, so the task of a term that all documents have holds a row per block.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = docs.repartition(parts, key).sortWithinPartitions(key)
    blocks = settled(_blocks(near.select(F.col(key).alias("key"), words.alias("words"))))
    n_docs = blocks.where("term is null").agg(F.sum("n")).first()[0] or 0
    df = blocks.where("term is not null").select("block", "term", F.sum("n").over(W.partitionBy("term")).alias("df")).where(F.col("df") >= min_df)
    df = df.select("block", "term", F.lit(b"").alias("posts"), F.array().cast(blocks.schema["keys"].dataType).alias("keys"), "df")
    rows = blocks.drop("n").withColumn("df", F.lit(None).cast("bigint")).unionByName(df).repartition(parts, "block").sortWithinPartitions("block")
    return _weighted(rows, n_docs, docs.schema[key])
