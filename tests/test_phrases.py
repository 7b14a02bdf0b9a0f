"""Phrase reuse: texts are cut once, packs of any size give the same pairs, no language is no owner."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import phrases
from parlance.operators import search
from parlance.plans import registry


def documents(n=300, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), " ".join(rng.choice("xyz") for _ in range(rng.randrange(9)))) for _ in range(n)]


def pairs(rows, n):
    sets: dict = {}
    for o, g, t in rows:
        w = t.split()
        if g is not None:
            sets.setdefault((o, g), set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {(o, a, b): len(x & y) for (o, a), x in sets.items() for (p, b), y in sets.items() if o == p and a < b and x & y}


def test_texts_are_cut_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = documents()
    df = spark.createDataFrame(rows, "lang string, source string, t string").select("lang", "source", read("t").alias("text"))
    out = search.phrase_reuse(df, "text", 4, "lang", "source").collect()
    assert {tuple(r)[:3]: r.n_grams for r in out} == pairs(rows, 4)
    assert seen.value == sum(g is not None for _, g, _ in rows)


@pytest.mark.parametrize("most", [2, 256])
def test_bounded_packs(most, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 5)
    rng = random.Random(most)
    import numpy as np

    digests = np.array([(rng.randrange(3), rng.randrange(9)) for _ in range(400)], np.uint64)
    ids = np.array([rng.randrange(-4, 4) for _ in digests], np.int64)
    want: dict = {}
    for d, i in zip(digests.tolist(), ids.tolist(), strict=True):
        want.setdefault(tuple(d), set()).add(i)
    once, who = phrases._distinct(digests, ids, False)
    assert sorted(zip(map(tuple, once.tolist()), who.tolist(), strict=True)) == sorted((d, i) for d, s in want.items() for i in s)
    rows = phrases._sets(digests, ids, most).to_pylist()
    assert sum(r["n"] for r in rows if r["k"] == 1) == sum(1 < len(s) <= most for s in want.values())
    assert sorted((r["g"], r["h"], i) for r in rows if r["k"] > 1 for i in r["members"]) == sorted((*d, i) for d, s in want.items() if len(s) > most for i in s)
    assert all(r["members"] == sorted(set(r["members"])) for r in rows)


def test_no_language_is_no_owner(spark, tmp_path):
    rows = [(i, "one two three four five six seven", lang, f"s{i}") for i, lang in enumerate([None, None, "en", "en"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.q_ngram_reuse(spark, str(tmp_path)).collect()] == [("en", "s2", "s3", 1)]


def test_short_digests():
    import numpy as np

    rng = np.random.default_rng(3)
    digests = rng.integers(0, 1 << 64, (500, 2), np.uint64)
    ids = np.sort(rng.integers(-3, 3, 50))
    batch = phrases._packed(digests, ids, np.full(50, 10))
    assert sum(len(r) for r in batch.column(1).to_pylist()) == 9 * 500  # 16 before
    got = sorted((*d, i) for r in batch.to_pylist() for d, i in zip(phrases._read(r["digests"], r["bucket"]).tolist(), np.repeat(r["ids"], r["counts"]).tolist(), strict=True))
    assert got == sorted((a, b & (1 << 20) - 1, i) for (a, b), i in zip(digests.tolist(), np.repeat(ids, 10).tolist(), strict=True))
