"""Names of a list, and tone with shifters, against brute force."""

import random

import pytest

from parlance.operators import entities, tone


def brute(text, names):
    t = " ".join(text.lower().split())
    word = lambda c: c.isalnum() or c == "_"
    out, i = [], 0
    while i < len(t):
        ok = [n for n in names if t.startswith(n, i) and not (i and word(t[i - 1]) and word(n[0])) and not (i + len(n) < len(t) and word(t[i + len(n)]) and word(n[-1]))]
        if ok:
            out.append((i, max(ok, key=len)))
            i += len(out[-1][1])
        else:
            i += 1
    return out


def test_mentions(spark):
    names = ["New York", "new york city", "York", "ann", "Ann Lee", "c++", "  ", "é", "a"]
    rng = random.Random(2)
    pieces = ["New", "york", "City", "ann", "Lee,", "annex", "c++", "é", "éa", "a", "x_a", "\n", "York!"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(0, 12)))) for i in range(200)] + [(900, None), (901, "")]
    got = entities.mentions(spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame([(n,) for n in names], "name string"), "t")
    assert got.columns == ["id", "entity", "position"]
    plain = [entities.squashed(n) for n in names if n.strip()]
    want = sorted((i, n, at) for i, t in rows if t for at, n in brute(t, plain))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_lists_are_checked(spark, monkeypatch):
    docs, some = spark.createDataFrame([(1, "ann")], "id int, t string"), spark.createDataFrame([("ann",)], "name string")
    assert entities.mentions(docs, some.limit(0), "t").isEmpty()
    monkeypatch.setattr(entities, "LARGEST", 2)
    with pytest.raises(ValueError, match="split"):
        entities.mentions(docs, some, "t")
    with pytest.raises(ValueError, match="rename"):
        entities.mentions(docs.withColumnRenamed("id", "Entity"), some, "t")


def test_shifted_tone(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("good", 1.0)], "word string, weight double")
    shifters = spark.createDataFrame([("not", "negation", None), ("very", "intensifier", 0.5), ("hardly", "intensifier", -3.0), ("but", "contrast", None)], "word string, kind string, strength double")
    cases = {"good": 2.0, "not good": -1.48, "not a very good": 2 * 1.5 * -0.74, "very a b good": 2 * 1.45, "not a b c good": 2.0, "bad but good": (-0.5 + 3.0) / 2, "hardly good": 0.0, "neither": 0.0, "Good, BAD!": 0.5, "but good but bad": (1.0 - 1.5) / 2}
    rows = [(i, t) for i, t in enumerate(cases)] + [(90, None), (91, "  ")]
    out = {r.id: (r.n_words, r.tone) for r in tone.shifted_tone(spark.createDataFrame(rows, "id int, t string"), lexicon, shifters, ["id"], "t").collect()}
    assert {i: round(v, 6) for i, v in enumerate(cases.values())} == {i: t for i, (_, t) in out.items()} and out[7][0] == 0 and out[5][0] == 2
