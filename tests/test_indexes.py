"""The scored index and the trigram index against scans."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.corpus import Corpus
from parlance.operators import index as I
from parlance.operators import search, trigrams
from parlance.operators.index import TextIndex
from parlance.operators.trigrams import TrigramIndex

WORDS = "sea sun moon star wind rain snow fire stone tree the and of".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, i % 7, " ".join(rng.choices(WORDS, weights=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 60, 50, 40], k=rng.randrange(1, 40))), "host" if i % 3 else "guest") for i in range(3000)]
    rows += [(5000, 0, "climate-change climate_change, Sea!", "host"), (5001, 0, "", "guest"), (5002, 0, None, "host"), (5003, 0, "climate talks", "host")]
    return spark.createDataFrame(rows, "episode_id long, turn_count long, turn_text string, role string").repartition(4).cache()


def brute(docs, query):
    rows = [(r.episode_id, re.findall(r"\w+", (r.turn_text or "").lower())) for r in docs.select("episode_id", "turn_text").collect()]
    n, avg = len(rows), sum(len(w) for _, w in rows) / sum(1 for _, w in rows if w)
    terms = set(re.findall(r"\w+", query.lower()))
    df = {t: sum(t in w for _, w in rows) for t in terms}
    idf = {t: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in terms}
    out = {}
    for i, w in rows:
        s = sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms if t in w)
        if any(t in w for t in terms):
            out[i] = round(s, 6)
    return out


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    old, I.BLOCK = I.BLOCK, 32
    try:
        return TextIndex.write(docs, ["episode_id", "turn_count"], "turn_text", str(tmp_path_factory.mktemp("index")), parts=4)
    finally:
        I.BLOCK = old


@pytest.mark.parametrize("query", ["sea", "the Sea sun", "climate-change", "nowhere", "the and of"])
def test_scores_and_best(docs, index, query):
    want = brute(docs, query)
    got = {r.episode_id: r.score for r in index.scores(query).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    best = [(r.episode_id, r.score) for r in index.best(query, 10).collect()]
    assert best == sorted(got.items(), key=lambda x: (-x[1], x[0]))[:10]
    guests = {r.episode_id for r in docs.where("role = 'guest'").collect()}
    some = [(r.episode_id, r.score) for r in index.best(query, 10, docs.where("role = 'guest'")).collect()]
    assert some == [x for x in sorted(got.items(), key=lambda x: (-x[1], x[0])) if x[0] in guests][:10]
    scanned = {r.episode_id: r.score for r in search.bm25(docs, "episode_id", "turn_text", query).collect()}
    assert scanned.keys() == got.keys() and all(abs(got[x] - scanned[x]) < 2e-6 for x in got)  # one tokenizer for both routes


def test_blocks_are_skipped(index, monkeypatch):
    monkeypatch.setattr(I, "PROBED", 8)
    read, all_ = index.blocks_read("sea", 3)
    assert all_ > 50 and read < 0.5 * all_


def test_search_turns_is_scored_by_the_whole_index(spark, docs, index):
    c = Corpus(spark, {"turns": docs.withColumn("podcast_id", F.col("episode_id") % 2), "podcasts": spark.createDataFrame([(0,), (1,)], "podcast_id long")}, index=index)
    whole = {(r.episode_id): r.score for r in c.search_turns("sea sun", limit=4000).collect()}
    some = c.search_turns("sea sun", limit=15, offset=2, role="guest").collect()
    assert len(some) == 15 and all(r.role == "guest" and whole[r.episode_id] == r.score for r in some)
    odd = c.restrict([1]).search_turns("sea sun", limit=15).collect()
    assert len(odd) == 15 and all(r.episode_id % 2 == 1 and whole[r.episode_id] == r.score for r in odd)
    assert all(r.episode_id % 2 == 1 for r in c.restrict([1]).search_episodes_by_text("sea", limit=20).collect())


def test_stemmed_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "running dogs run"), ("b", "the dog"), ("c", "cats"), ("d", "")], "key string, text string")
    made = TextIndex.write(docs, ["key"], "text", str(tmp_path), True, ("the",), 2)
    got = {r.key: r.score for r in made.scores("The Dogs running").collect()}
    assert set(got) == {"a", "b"} and got["a"] > got["b"] > 0
    avg, idf = (3 + 1 + 1) / 3, math.log((4 - 2 + 0.5) / 2.5 + 1)
    assert got["b"] == round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 / avg)), 6)
    assert [r.key for r in TextIndex.open(spark, str(tmp_path)).best("dogs", 1).collect()] == ["b"]


def test_empty_index(spark, tmp_path):
    made = TextIndex.write(spark.createDataFrame([], "k int, t string"), ["k"], "t", str(tmp_path))
    assert made.scores("x").isEmpty() and made.best("x", 3).isEmpty()


@pytest.fixture(scope="module")
def grams(spark, docs, tmp_path_factory):
    return TrigramIndex.write(docs, ["episode_id", "turn_count"], "turn_text", str(tmp_path_factory.mktemp("grams")), parts=4)


@pytest.mark.parametrize(("query", "mode"), [("Sea SUN", "exact"), ("climate-", "exact"), ("st", "exact"), ("of the and of", "exact"), ("sea (sun|moon)", "regex"), (r"^snow|fire$", "regex"), (r"(?i)CLIMATE", "regex"), (r"[A-Z]ea!", "regex"), (r"\bsta+r (wind )?rain\b", "regex"), (r"\p{Lu}ea", "regex"), ("nothing", "exact")])
def test_trigram_search_equals_the_scan(docs, grams, query, mode):
    keys = lambda df: sorted(r.episode_id for r in df.collect())
    assert keys(search.scan(grams.candidates(docs, query, mode), query, mode)) == keys(search.scan(docs, query, mode))


def test_trigrams_rule_out_most(docs, grams):
    pattern = "sea sun moon"
    met, whole = grams.candidates(docs, pattern, "exact").count(), docs.count()
    assert search.scan(docs, pattern, "exact").count() <= met < 0.05 * whole


def test_concordance_and_search_by_trigrams(spark, docs, grams):
    c, plain = (Corpus(spark, {"turns": docs}, trigrams=g) for g in (grams, None))
    for call in (lambda x: x.concordance("sea  sun", 3), lambda x: x.search_turns("sea sun", "exact", limit=50, role="host"), lambda x: x.search_turns("sea (sun|moon)", "regex", limit=50)):
        assert sorted(map(str, call(c).collect())) == sorted(map(str, call(plain).collect()))


def test_letters_beyond_ascii(spark, tmp_path):
    rows = [(0, "ABÇDEF"), (1, "300 K elvin"), (2, "İstanbul"), (3, "STRASSE ΟΔΟΣ"), (4, None)]
    docs = spark.createDataFrame(rows, "id int, t string")
    made = TrigramIndex.write(docs, ["id"], "t", str(tmp_path))
    for q in ("abçdef", "300 k elv", "stanbul", "strasse οδος", "stanbul".upper()):
        want = sorted(r.id for r in search.scan(docs, q, "exact", "t").collect())
        assert sorted(r.id for r in search.scan(made.candidates(docs, q, "exact"), q, "exact", "t").collect()) == want


def test_plans():
    assert trigrams.pattern_plan("(abcd|efg)x?yz1") == ("and", (("or", (("and", ("abc", "bcd")), "efg")), "yz1"))
    assert trigrams.pattern_plan("abc|x") is None and trigrams.pattern_plan("[a-z&&[^b]]abc") is None and trigrams.pattern_plan("(abc)*") is None
    assert trigrams.pattern_plan("a$bc") is None and trigrams.pattern_plan(r"\Qa.c\E") is None and trigrams.pattern_plan("(") is None


def test_trigrams_of_a_long_text(spark, tmp_path):
    """Quadratic in the text's length, this would take minutes."""
    import time

    docs = spark.createDataFrame([(0, "abc " * 250_000 + "tail end"), (1, "abc")], "id int, t string")
    began = time.time()
    made = TrigramIndex.write(docs, ["id"], "t", str(tmp_path), parts=2)
    assert [r.id for r in made.candidates(docs, "ail end", "exact").collect()] == [0] and time.time() - began < 60


def test_blocks_over_many_batches(spark, tmp_path, monkeypatch):
    """A block that comes in several batches is one row a term, with its postings in the order of the keys."""
    monkeypatch.setattr(I, "BLOCK", 16)
    docs = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("sea sea w"), F.col("id") % 3, F.lit(" running runs")).alias("t"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        made = TextIndex.write(docs, ["k"], "t", str(tmp_path), stemmed=True, parts=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    rows = made.blocks.where("term = 'run'").orderBy("block").collect()
    assert len({r.block for r in rows}) == len(rows) and [p.key.k for r in rows for p in r.postings] == list(range(100))
    assert all(r.n == len(r.postings) <= 16 and {(p.tf, p.dl) for p in r.postings} == {(2, 5)} for r in rows)
