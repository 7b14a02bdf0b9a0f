from test_similar import classes

import corpus_pipeline
from parlance.llm import langid, mixing


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
    before, after = seen["language"]
    told = langid.identify(before, langid.train(before.where(~langid.held_out())))
    assert after.count() == told.where("accepted").count()
    before, after = seen["near_duplicates"]
    want = classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))
    before, after = seen["mixture"]
    words = lambda t: len((t or "").split())
    total = sum(words(r.text) for r in before.collect())
    assert abs(sum(words(r.text) for r in after.collect()) - 1.5 * total) <= 20 + 0.01 * total
    before, after = seen["packed"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_tables_without_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).isEmpty()


def test_mixture_when_the_second_scan_is_split_otherwise(spark, monkeypatch):
    d, key = "/root/testdata/sf0.001", "spark.sql.files.maxPartitionBytes"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.mixture(spark, docs, d).collect())
    before, mix = spark.conf.get(key), mixing.mix

    def split(*args):
        out = mix(*args)
        spark.conf.set(key, "10k")
        return out

    monkeypatch.setattr(mixing, "mix", split)
    try:
        got = corpus_pipeline.mixture(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        assert sorted((r.doc_id, r.text or "") for r in got.collect()) == want
    finally:
        spark.conf.set(key, before)
