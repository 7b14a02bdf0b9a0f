"""Whole-graph measures, topics, taxonomy and the command line."""

import itertools
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from parlance.__main__ import parser, run
from parlance.functions import taxonomy
from parlance.operators import network, topics


def graph(n, m, seed):
    r = random.Random(seed)
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, r.randint(1, 4)) for a, b in sorted(pairs)]


def brute_betweenness(edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s, t):  # every shortest path
        best, out, todo = None, [], deque([[s]])
        while todo:
            p = todo.popleft()
            if best is not None and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                out.append(p)
                continue
            todo.extend([*p, y] for y in near[p[-1]] if y not in p)
        return out

    score, n = dict.fromkeys(near, 0.0), len(near)
    for s, t in itertools.combinations(near, 2):
        found = paths(s, t)
        for x in near:
            score[x] += sum(x in p[1:-1] for p in found) / len(found)
    return {x: v * 2 / ((n - 1) * (n - 2)) for x, v in score.items()}


def test_betweenness(spark):
    edges = graph(9, 5, 2)
    got = {r.node: r.betweenness for r in network.betweenness(spark.createDataFrame(edges, "a int, b int, weight int")).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_betweenness_of_a_dense_graph(spark):
    h = 400  # two layers, every node of one joined to all of the other
    df = spark.range(h).selectExpr("id AS a").crossJoin(spark.range(h).selectExpr("1000 + id AS b")).withColumn("weight", F.lit(1))
    network.betweenness(df.limit(3)).count()  # starts workers
    began = time.time()
    got = {r.node: r.betweenness for r in network.betweenness(df).collect()}
    assert time.time() - began < 12  # a dictionary look-up per source and edge takes longer
    assert len(got) == 2 * h and all(abs(v - (h - 1) / ((2 * h - 1) * (2 * h - 2))) < 2e-9 for v in got.values())


def test_betweenness_of_no_edges_and_too_many(spark, monkeypatch):
    empty = spark.createDataFrame([], "a int, b int, weight int")
    assert network.betweenness(empty).isEmpty() and network.communities(empty).isEmpty()
    monkeypatch.setattr(network, "MAX_EDGES", 2)
    with pytest.raises(ValueError):
        network.betweenness(spark.createDataFrame(graph(9, 5, 2), "a int, b int, weight int"))


def modularity(edges, of):
    total = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if of[a] == of[b]) / total
    share = {}
    for a, b, w in edges:
        for x in (a, b):
            share[of[x]] = share.get(of[x], 0) + w / (2 * total)
    return inside - sum(v * v for v in share.values())


def test_communities(spark):
    cliques = [(g * 10 + i, g * 10 + j, 2) for g in range(4) for i in range(6) for j in range(i)] + [(g * 10, g * 10 + 10, 1) for g in range(3)]
    of = {r.node: r.community for r in network.communities(spark.createDataFrame(cliques, "a int, b int, weight int")).collect()}
    assert {x: c for x, c in of.items()} == {g * 10 + i: g for g in range(4) for i in range(6)}
    edges = graph(14, 12, 5)
    of = {r.node: r.community for r in network.communities(spark.createDataFrame(edges, "a int, b int, weight int")).collect()}
    base = modularity(edges, of)
    for x, y in itertools.combinations(set(of.values()), 2):  # no union gains
        assert modularity(edges, {k: x if v == y else v for k, v in of.items()}) <= base + 1e-12


def test_core(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (8, 9, 1)], "a int, b int, weight int")
    assert sorted((r.a, r.b) for r in network.core(e).collect()) == [(1, 2), (2, 3)]


def test_topics_tell_two_subjects_apart(spark):
    r = random.Random(1)
    subjects = [[f"{p}{c}word" for c in "abcdefghijkl"] for p in ("sea", "sun")]
    rows = [(i, 0, [r.choice(subjects[i % 2]) for _ in range(60)]) for i in range(40)]
    df = spark.createDataFrame(rows, "episode_id int, window_index int, terms array<string>")
    weights, keys = topics.fit_topics(df, k=2, iterations=30, seed=3)
    got = {x.episode_id: x.topic for x in topics.main_topic(weights).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and len({got[i] for i in range(1, 40, 2)}) == 1 and got[0] != got[1]
    assert keys.count() == 2


def test_taxonomy(spark):
    assert len(taxonomy.CATEGORIES) == 19 and taxonomy.valid("Physics") and not taxonomy.valid("physics")
    assert taxonomy.search("NEWS") == ["Business News", "Daily News", "Entertainment News", "News Commentary", "Sports News", "Tech News"]
    assert taxonomy.siblings("Improv") == ["Comedy Interviews", "Improv", "Stand-Up"] == taxonomy.siblings("Comedy")
    assert taxonomy.category_table(spark).count() == len(taxonomy.MAIN_OF) + 4
    assert set(taxonomy.POPULAR) <= set(taxonomy.MAIN_OF) and taxonomy.CODE_OF["German"] == "de"


def test_command_line(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/metadata/{name}.parquet")
    put("podcast_catalog", [("p1", "Sea Talk", "x"), ("p2", "Talk", "y")], "podcast_id string, pod_title string, pod_description string")
    put("episode_catalog", [("e1", "p1", "A", 3600.0, 2, "en", "Arts"), ("e2", "p2", "B", 60.0, 1, "de", "News")], "episode_id string, podcast_id string, ep_title string, duration_seconds double, num_main_speakers int, language string, category1 string")
    put("category_index", [("Arts", "p1")], "category string, podcast_id string")
    at = ["--parquet-dir", str(tmp_path)]
    told = lambda *a: run(spark, parser().parse_args([*a, *at]))
    assert told("stats")[1].split("\t")[:2] == ["2", "2"] and "Arts\t1" in told("stats")
    assert told("search-podcast", "talk")[1].startswith("p2")
    assert [x.split("\t")[0] for x in told("search-episodes", "--min-duration", "100")[1:]] == ["e1"]
    assert len(told("search-episodes", "--category", "arts")) == 2
    assert told("columns", "episode_catalog", "--grep", "DOUBLE") == ["duration_seconds\tdouble"] and "category_index" in told("columns")
