"""tf-idf weights: texts are cut once, and blocks of any size give the same weights."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators import search, weights

ODD = ["", " ,", None, "É_1 é_1 x", "ñ x", "a a a", "x" * 50]


def want(rows, min_df=2):
    docs: dict = {}
    for k, t in rows:
        docs.setdefault(k, Counter()).update(x for x in re.split(r"[^\w]+", (t or "").lower()) if x)
    df = Counter(t for c in docs.values() for t in c)
    out = {}
    for k, c in docs.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= min_df}
        length = math.sqrt(sum(x * x for x in w.values()))
        out |= {(k, t): x / length for t, x in w.items()}
    return out


@pytest.mark.parametrize("block,kind", [(1, "long"), (7, "string"), (1 << 19, "long")])
def test_blocks(spark, monkeypatch, block, kind):
    monkeypatch.setattr(weights, "BLOCK", block)
    rng = random.Random(block)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = [(rng.choice([None, *range(30)]), rng.choice([*ODD, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9)))])) for _ in range(150)]
    rows = [(k if k is None or kind == "long" else f"k{k}", t) for k, t in rows]
    df = spark.createDataFrame(rows, f"item {kind}, text string").select("item", read("text").alias("t"))
    out = search.tfidf(df, "item", "t")
    assert out.columns == ["item", "term", "weight"]
    got = {(r.item, r.term): r.weight for r in out.collect()}
    assert got.keys() == (w := want(rows)).keys() and all(abs(got[x] - w[x]) < 1e-12 for x in w)
    assert seen.value == len(rows)


def test_nothing(spark):
    assert search.tfidf(spark.createDataFrame([], "k int, t string"), "k", "t").isEmpty()
    assert search.tfidf(spark.createDataFrame([(1, None), (2, "")], "k int, t string"), "k", "t").isEmpty()
