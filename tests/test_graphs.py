"""Measures of large graphs against the exact forms of small ones."""

import random

from pyspark.sql import functions as F

from parlance.operators import graphs, network
from test_analyses import brute_betweenness, graph
from test_analyses import modularity as exact_modularity


def test_betweenness_of_all_pivots_is_exact(spark):
    edges = [*graph(9, 5, 2), (20, 21, 1), (3, 3, 1), (1, 0, 1)]  # another component, a loop, an edge again
    got = {r.node: r.betweenness for r in graphs.sampled_betweenness(spark.createDataFrame(edges, "a int, b int, weight int"), 100).collect()}
    n = 11
    plain = brute_betweenness(graph(9, 5, 2))
    want = {x: v * 8 * 7 / ((n - 1) * (n - 2)) for x, v in plain.items()} | {20: 0.0, 21: 0.0}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_sampled_betweenness_stays_within_its_bound(spark):
    edges = graph(60, 30, 3)
    df = spark.createDataFrame(edges, "a int, b int, weight int")
    exact = {r.node: r.betweenness for r in graphs.sampled_betweenness(df, 60).collect()}
    some = {r.node: r.betweenness for r in graphs.sampled_betweenness(df, 30, seed=1).collect()}
    assert some.keys() == exact.keys() and max(abs(some[x] - exact[x]) for x in exact) < graphs.error_bound(60, 30)
    assert graphs.error_bound(60, 60) == 0.0 and graphs.sampled_betweenness(df.limit(0), 5).isEmpty()


def test_local_communities(spark):
    cliques = [(g * 10 + i, g * 10 + j, 2) for g in range(4) for i in range(6) for j in range(i)] + [(g * 10, g * 10 + 10, 1) for g in range(3)]
    of = {r.node: r.community for r in graphs.local_communities(spark.createDataFrame(cliques, "a int, b int, weight int")).collect()}
    assert of == {g * 10 + i: g * 10 for g in range(4) for i in range(6)}
    rng = random.Random(7)
    edges = [(i, j, 1) for i in range(45) for j in range(i) if rng.random() < (0.5 if i // 15 == j // 15 else 0.03)]
    of = {r.node: r.community for r in graphs.local_communities(spark.createDataFrame(edges, "a int, b int, weight int")).collect()}
    planted = {i: i // 15 for i in range(45)}
    assert exact_modularity(edges, of) >= exact_modularity(edges, planted) - 0.02
    assert graphs.local_communities(spark.createDataFrame([], "a int, b int, weight int")).isEmpty()


def test_pairs_are_shuffled_as_lists(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(m, f"g{rng.randrange(1 + m) % 40:02d}") for m in range(60) for _ in range(12)] + [(None, "g01"), (None, "g02"), (3, None)]
    df = spark.createDataFrame(rows, "m int, g string")
    own: dict = {}
    for m, g in rows:
        if m is not None and g is not None:
            own.setdefault(m, set()).add(g)
    want: dict = {}
    for gs in own.values():
        for a in gs:
            for b in gs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert network.meetings(df, "m", "g").count() == sum(len(gs) - 1 for gs in own.values()) < sum(want.values())
    for block, hot in ((256, 100_000), (4, 100_000), (256, 5), (3, 2)):
        monkeypatch.setattr(network, "BLOCK", block)
        monkeypatch.setattr(network, "HOT", hot)
        assert {(r.a, r.b): r.weight for r in network.shared_pairs(df, "m", "g").collect()} == want


def test_settled_frames_tell_their_size(spark):
    from parlance.sources.session import settled

    big = settled(spark.range(200).select(F.col("id").alias("node"), (F.col("id") % 7).alias("c")))
    joined = spark.range(10).withColumnRenamed("id", "node").join(big, "node")
    assert big.count() == 200 and joined.count() == 10 and "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_core_measures_in_a_new_session():
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
from parlance.plans import registry
print(registry.QUERIES["q_betweenness"](s, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) > 0, done.stderr[-2000:]


def test_core_measures_beyond_the_limit(spark, monkeypatch):
    from parlance.plans import registry

    d = "/root/testdata/sf0.001"
    exact = {r.node: r.betweenness for r in registry.QUERIES["q_betweenness"](spark, d).collect()}
    monkeypatch.setattr(network, "MAX_EDGES", 2)
    got = {r.node: r.betweenness for r in registry.QUERIES["q_betweenness"](spark, d).collect()}
    assert got.keys() == exact.keys() and all(abs(got[x] - exact[x]) < 1e-8 for x in exact)
    of = {r.node: r.community for r in registry.QUERIES["q_communities"](spark, d).collect()}
    sizes = [list(of.values()).count(i) for i in range(max(of.values()) + 1)]
    assert of.keys() == exact.keys() and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_pairs_are_counted_by_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(m, rng.randrange(30)) for m in range(80) for _ in range(9)]
    df = spark.createDataFrame(rows, "m int, g bigint")
    want = {(r.a, r.b): r.weight for r in network.shared_pairs(df, "m", "g").collect()}
    own = {m: {g for x, g in rows if x == m} for m, _ in rows}
    assert want == {(a, b): n for a in range(30) for b in range(a + 1, 30) if (n := sum(a in gs and b in gs for gs in own.values()))}
    for pairs in (1, 7, 100):
        monkeypatch.setattr(network, "PAIRS", pairs)
        assert {(r.a, r.b): r.weight for r in network.shared_pairs(df, "m", "g").collect()} == want


def test_settled_frames_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from parlance.sources import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(session, "COUNTED", (0, 10 << 20))
    big = session.settled(spark.range(200).select(F.col("id").alias("node"), (F.col("id") % 7).alias("c")))
    joined = spark.range(1000).withColumnRenamed("id", "node").join(big.select("node", "c"), "node").groupBy("c").count()
    assert joined.count() == 7 and "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()
