from pyspark.sql import functions as F

from parlance.llm import mixing


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, source string, size long")


def brute(sizes, share=1.5, most=2.0):
    """Excess goes back by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_words(spark):
    docs = [(i, ["a", "b", "c", None, "é", "Z"][i * i % 6], i * 37 % 101) for i in range(900)] + [(5, "a", 84), (5, "a", 84), (9999, "zero", 0)]
    out = mixing.mix(rows(spark, docs)).collect()
    sizes: dict = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want = brute(sizes)
    got: dict = {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.words
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.words <= r.size
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
    per: dict = {}
    for r in out:
        per.setdefault((r.doc_id, r.source, r.size), []).append(r)
    assert set(per) == set(docs)
    assert all(sum(x.words for x in v) <= 2 * k[2] * docs.count(k) for k, v in per.items())
    key = lambda r: (r.doc_id, str(r.source), str(r["pass"]), str(r.shard), r.words)
    assert sorted(map(key, mixing.mix(rows(spark, docs)).collect())) == sorted(map(key, out))


def test_shards_share_every_source(spark):
    docs = [(i, "big" if i % 3 else "small", 10) for i in range(30_000)]
    draws = mixing.mix(rows(spark, docs)).where("pass is not null").select("shard", "source", "pass", "block")
    out = draws.distinct().groupBy("shard", "source").count().collect()
    total = sum(r["count"] for r in out)
    size = total / 8
    for source in ("big", "small"):
        own = {r.shard: r["count"] for r in out if r.source == source}
        p = sum(own.values()) / total
        deviation = (size * p * (1 - p) * (total - size) / (total - 1)) ** 0.5  # of a hypergeometric count
        assert set(own) == set(range(8)) and all(abs(n - size * p) <= 4.5 * deviation for n in own.values())
    assert max(sum(r["count"] for r in out if r.shard == i) for i in range(8)) <= size + 1


def test_empty_and_wordless(spark):
    assert mixing.mix(rows(spark, [])).isEmpty()
    assert [r.words for r in mixing.mix(rows(spark, [(1, "a", 0)])).collect()] == [0]


def test_hypergeometric(spark):
    from collections import Counter
    from math import comb

    from pyspark.sql import functions as F

    for good, total, need in [(5, 12, 4), (30, 40, 20), (0, 9, 3), (9, 9, 3), (7, 50, 50), (18, 40, 17)]:
        df = spark.range(4000).select(mixing.hypergeometric(*[F.lit(x).cast("bigint") for x in (good, total, need)], (F.col("id") + 0.5) / 4000).alias("x"))
        got = Counter(r.x for r in df.collect())
        for x in range(good + 1):
            p = comb(good, x) * comb(total - good, need - x) / comb(total, need) if 0 <= need - x <= total - good else 0
            assert abs(got[x] - 4000 * p) <= 1.5
        assert set(got) <= set(range(good + 1))
    far = spark.range(50).select(mixing.hypergeometric(F.lit(4 * 10**8), F.lit(10**9), F.lit(5 * 10**8), (F.col("id") + 0.5) / 50).alias("x"))
    xs = sorted(r.x for r in far.collect())
    deviation = (5e8 * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(sum(xs) / 50 - 2e8) < deviation and abs(xs[8] - 2e8 + deviation) < deviation / 4 and abs(xs[41] - 2e8 - deviation) < deviation / 4


def test_tree_decides(spark, monkeypatch):
    docs = rows(spark, [(i, "ab"[i % 2], i % 50) for i in range(3000)])
    own = mixing.mix(docs).where("words > 0").count()
    plan = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: plan(*a).where("source = 'a'"))
    assert 0 < mixing.mix(docs).where("words > 0").count() < own
    assert mixing.mix(docs).where("source = 'b' and words > 0").isEmpty()


def test_whole_documents(spark):
    docs = [(i, "ab"[i % 2], i * 31 % 97) for i in range(2000)]
    out = mixing.mix(rows(spark, docs), cut=False).collect()
    assert all(r.words in (0, r.size) for r in out)
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.words for r in own) - own[0].target) <= 97 / 2
    assert sorted((r.shard, r.place) for r in out if r.words) == [(s, p + 1) for s in sorted({r.shard for r in out if r.words}) for p in range(sum(r.shard == s and r.words > 0 for r in out))]


def test_reruns_agree(spark, tmp_path):
    text = lambda i: None if i % 13 == 0 else "w " * (i % 40)
    docs = [(i % 700, text(i), "xyz"[i % 3] if i % 11 else None, 1) for i in range(1500)]
    seen = []
    for parts in (1, 7):
        folder = tmp_path / str(parts)
        spark.createDataFrame(docs, "doc_id long, text string, source string, size int").repartition(parts).write.parquet(str(folder / "documents.parquet"))
        seen.append(sorted(map(str, mixing.op3_mixing(spark, str(folder)).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 1500


def test_many_sources_in_groups(spark):
    quotas = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id"))).alias("source"), F.when(F.col("id") == 5, F.lit(50_000)).otherwise(F.col("id") % 3).cast("bigint").alias("quota"))
    plan = mixing.split_tree(quotas, 3, 9).cache()
    assert plan.where("n <= 0").isEmpty() and [r.n for r in plan.groupBy("shard").agg(F.sum("n").alias("n")).select((F.col("n") - (50_000 + 20_000 - 3) / 8).alias("n")).collect() if abs(r.n) > 8] == []
    got = plan.groupBy("source").agg(F.sum("n").alias("n"), F.max("before").alias("before"))
    assert got.join(quotas, got["source"].eqNullSafe(quotas["source"]), "full").where("not coalesce(n, 0) <=> quota").isEmpty()
    hot = [r.n for r in plan.where("source = 's5'").collect()]
    assert len(hot) == 8 and all(abs(n - 50_000 / 8) < 250 for n in hot)


def test_groups_of_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WIDE", 3)
    quotas = spark.range(40).select(F.col("id").cast("string").alias("source"), (F.col("id") % 5).alias("quota"))
    plan = mixing.split_tree(quotas, 3, 1).collect()
    per: dict = {}
    for r in plan:
        per[r.source] = per.get(r.source, 0) + r.n
    assert per == {str(i): i % 5 for i in range(40) if i % 5}
    sizes = [sum(r.n for r in plan if r.shard == k) for k in range(8)]
    assert sum(sizes) == 80 and max(sizes) - min(sizes) <= 2
