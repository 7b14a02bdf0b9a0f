"""Pairs by shared phrases and by cosine, and word positions, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import search, stats


def test_phrase_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUPS", 8)
    rng = random.Random(3)
    rows = [("en", i, f"All of THEM say it, {'it is ' * rng.randrange(4)}w{'abcdefg'[rng.randrange(7)]} x{'abcdefg'[rng.randrange(7)]} y z") for i in range(60)]
    rows += [("de", i, "all of them say it") for i in range(3)] + [("de", 1, "all of them say it"), ("de", 7, "too few"), ("de", 8, None), (None, 1, "all of them say it"), (None, 2, "all of them say it")]
    sets: dict = {}
    for o, g, t in rows:
        w = re.findall("[a-z']+", (t or "").lower())
        sets.setdefault((o, g), set()).update(tuple(w[i : i + 4]) for i in range(len(w) - 3))
    want = {(o, a, b): len(x & y) for (o, a), x in sets.items() for (p, b), y in sets.items() if o == p and a < b and x & y}
    for names in (("lang", "source"), ("g", "h")):  # whatever the columns are called
        df = spark.createDataFrame(rows, f"{names[0]} string, {names[1]} long, t string")
        out = search.phrase_reuse(df, "t", 4, *names)
        assert out.columns == [names[0], "a", "b", "n_grams"] and {(r[0], r[1], r[2]): r[3] for r in out.collect()} == want


def test_phrase_in_ten_thousand_groups(spark):
    text = F.when(F.col("id") < 2000, F.lit("one two three four")).otherwise(F.concat(F.lit("five six seven "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
    df = spark.range(10_000).select(F.lit("x").alias("lang"), F.col("id").alias("source"), text.alias("t"))
    assert search.phrase_reuse(df, "t", 4, "lang", "source").count() == 2000 * 1999 // 2


def vectors(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = {f"t{rng.randrange(40)}": rng.random() for _ in range(rng.randrange(1, 6))} | {"hot": 0.05, f"own{i}": 0.01}
        if i % 10 == 9:
            w = dict((k, v) for _, k, v in [x for x in rows if x[0] == i - 1])
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows += [(i, k, v / norm) for k, v in w.items()]
    return rows, spark.createDataFrame(rows, "doc int, term string, weight double").withColumn("g", F.col("doc") % 4)


def cosines(rows):
    by: dict = {}
    for i, t, w in rows:
        by.setdefault(i, {})[t] = w
    return {(a, b): sum(w * by[b].get(t, 0.0) for t, w in by[a].items()) for a in by for b in by if a < b}


@pytest.mark.parametrize("least", [0.05, 0.5, 0.9, 1.0 - 1e-9])
def test_similar_pairs(spark, least):
    rows, df = vectors(spark)
    want = {k: v for k, v in cosines(rows).items() if v >= least}
    got = {(r.a, r.b): r.cosine for r in search.similar_pairs(df, "doc", least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and (len(want) > 0)


def test_no_pairs(spark):
    _, df = vectors(spark, 3)
    assert search.similar_pairs(df.limit(0), "doc", 0.5).isEmpty()
    with pytest.raises(ValueError):
        search.similar_pairs(df, "doc", 0.0)


def test_mean_cosines(spark):
    rows, df = vectors(spark)
    sums: dict = {}
    for (a, b), c in cosines(rows).items():
        k = str(a % 4) if a % 4 == b % 4 else None
        n, total = sums.get(k, (0, 0.0))
        sums[k] = (n + 1, total + c)
    got = {r.group: (r.n_pairs, r.mean_cosine) for r in stats.mean_cosines(df, "doc", "g").collect()}
    assert got.keys() == sums.keys() and all(got[k][0] == n and abs(got[k][1] - t / n) < 1e-6 for k, (n, t) in sums.items())
    assert stats.mean_cosines(df.limit(0), "doc", "g").isEmpty() and stats.mean_cosines(df.where("doc = 1"), "doc", "g").isEmpty()


@pytest.mark.parametrize("word", ["aa", "a.", "the", "(x", "é"])
def test_word_positions(spark, word):
    texts = ["aaaa the theThe a.a. (x(x", "é (é) É", "", None, "the"]
    df = spark.createDataFrame([(1, i, float(i), i + 1.0, t) for i, t in enumerate(texts)], "episode_id int, turn_count int, start_time double, end_time double, turn_text string")
    want = [(i, round(i + k / len(t), 4)) for i, t in enumerate(texts) if t for k in range(len(t)) if t.lower()[k : k + len(word)] == word]
    assert sorted((r.turn_count, r.estimate) for r in search.word_positions(df, word).collect()) == want
