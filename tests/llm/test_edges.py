"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import ann, langid, mixing, packing, pii, quality, repeats, simhash, similar

LONG = "the quick brown fox jumps over lazy dogs and runs away again " * 12_000
CLASHES = ["shard", "place", "d1", "n_replaced", "component_id", "fp", "sketch", "piece", "start", "length", "k1", "r", "__key", "best", "low", "turn", "words"]


def rows():
    base = [
        (1, "A short note about the weather in the north and the south of the land.", "en", "a", 70),
        (1, "A short note about the weather in the north and the south of the land.", "en", "a", 70),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \n\t ", "de", None, 4),
        (None, "Nobody knows which document this text belongs to, and yet it has words.", "en", "b", 71),
        (5, LONG, "en", "a", len(LONG)),
        (6, "Ein kurzer Text über das Wetter im Norden und im Süden des Landes.", "de", "b", 66),
        (6, "Zwei Texte haben dieselbe Nummer, und dieser hier ist der andere davon.", "de", "b", 71),
        (7, "12345 67890", None, None, 11),
    ]
    return base + [(100 + i, f"Document number {i} tells of {i * 7} things that nobody has counted before it was written {i}.", "en", "ab"[i % 2], 90) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    plain = stage(spark, docs, "/nowhere")
    odd = stage(spark, clashing(docs), "/nowhere")
    assert plain.columns == odd.columns and (name == "packed" or plain.columns == docs.columns)
    key = lambda r: str(sorted((k, str(v)) for k, v in r.asDict().items() if k not in ("sequence_id", "offset")))
    got = sorted(map(key, plain.collect()))
    assert got == sorted(map(key, odd.collect())) and stage(spark, docs.limit(0), "/nowhere").isEmpty()
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in plain.collect() if (r.doc_id or 0) < 100) == ["1", "2", "5", "6", "7", "None"]
    if name == "personal_data":
        assert len(got) == docs.count()
    if name == "mixture":
        assert plain.where("text is null or trim(text) = ''").isEmpty() and plain.where("doc_id = 5").count() >= 0


def test_packing(spark, docs):
    pieces = packing.tokenize(clashing(docs), *packing.vocabulary()).cache()
    assert pieces.where("doc_id in (2, 3)").select("length", "start").distinct().collect() == [(1, 0)]
    assert pieces.where("piece = 0").count() == docs.count()
    out = packing.pack(pieces)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n <> end or n > 1024").isEmpty() and out.count() == pieces.count()
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("salt", F.lit(1)))
    text_ids = packing.tokenize(docs.withColumn("doc_id", F.col("doc_id").cast("string")), *packing.vocabulary())
    assert text_ids.schema["doc_id"].dataType.simpleString() == "string" and text_ids.count() == pieces.count()


def test_mixing(spark, docs):
    keyed = mixing.row_keys(docs, F.xxhash64("text"))
    assert keyed.count() == docs.count() and keyed.select("doc_id").distinct().count() == docs.count()
    out = mixing.mix(clashing(keyed))
    assert out.select("doc_id").distinct().count() == docs.count() and out.where("words > size").isEmpty()
    assert mixing.mix(keyed.withColumn("size", F.lit(None).cast("long"))).where("words > 0").isEmpty()


def test_repeats(spark, docs):
    out = {(r.doc_id, r.n_bytes): len(r.kept) for r in repeats.remove_repeats(clashing(docs)).collect()}
    assert out[5, len(LONG)] == 0 and out[2, 0] == 0 and out[1, 70] == 70  # a text of repeats covers itself; 70 bytes hold no window
    assert repeats.remove_repeats(clashing(docs)).count() == docs.count()


def test_simhash(spark, docs):
    out = simhash.near_duplicates(clashing(docs)).collect()
    of = {(r.doc_id, r.fp) for r in out}
    assert len(out) == docs.count() and {r.fp for r in out if r.doc_id in (2, 3, 4)} == {0} and len({f for i, f in of if i == 1}) == 1
    assert {r.component_id for r in out if r.doc_id in (2, 3, 4)} == {2}
    near = similar.near_duplicates(clashing(docs)).collect()
    assert len(near) == docs.count() and {r.component_id for r in near if r.doc_id in (2, 3, 4)} == {2}


def test_language(spark, docs):
    known = langid.train(clashing(docs))
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs, known).collect()}
    assert out[2] == out[3] == out[4] == out[7] == "und" and out[5] == "en"
    with pytest.raises(ValueError):
        langid.identify(docs.withColumn("score", F.lit(1)), known)


def test_personal_data_and_quality(spark, docs):
    assert pii.pseudonymize(docs).where("n_replaced > 0").isEmpty() and pii.pseudonymize(docs).count() == docs.count()
    with pytest.raises(ValueError):
        pii.pseudonymize(clashing(docs))
    stats = quality.with_stats(clashing(docs)).drop("text").cache()
    out = quality.quality_rules(stats)
    assert out.count() == docs.count() and out.where("doc_id = 2").first().base_failed and out.where("doc_id = 5").first().n_words == 144_000


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cid", "v", "ids", "rank", "curve")})
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 3, k=5).orderBy("rank").collect()] == [(3, 1, 0, 0.0), (3, 2, 0, 0.0)]
