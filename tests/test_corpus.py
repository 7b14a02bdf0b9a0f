"""The corpus facade, schema registry, stems, audits and build steps on hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.corpus import Corpus
from parlance.functions import exprs as X
from parlance.functions.stemmer import stem
from parlance.operators import audit, build, catalog, frames, network, search, stats, windows
from parlance.sources import readers, schema


@pytest.fixture(scope="module")
def corpus(spark):
    shows = spark.createDataFrame([("p1", "Alpha Talks", "https://Feeds.one.example/a"), ("p2", "Beta Hour", "https://two.example/b"), ("p3", "alpha talks", None)], "podcast_id string, pod_title string, rss_url string")
    episodes = spark.createDataFrame(
        [("e1", "p1", "First", 3000.0, "en", ["Ann"], ["Bo"], 2, "1700000000000", ["Arts"]), ("e2", "p1", "Second", 500.0, "en", ["Ann"], [], 1, None, ["Arts", "Comedy"]), ("e3", "p2", "Third", 900.0, "de", [" Cy "], ["Bo", "Di"], 3, "x", [])],
        "episode_id string, podcast_id string, ep_title string, duration_seconds double, language string, host_predicted_names array<string>, guest_predicted_names array<string>, num_main_speakers long, episode_date string, categories array<string>",
    )
    turns = spark.createDataFrame(
        [("e1", "p1", 0, "hello there world", 0.0, 5.0, ["A"], "host"), ("e1", "p1", 1, "well of the running dogs", 6.0, 9.0, ["B", "A"], "guest"), ("e1", "p1", 2, " ", 9.0, 9.0, [], "NO_INFERRED_ROLE"), ("e3", "p2", 0, "the dog runs", 0.0, 2.0, ["A"], "host")],
        "episode_id string, podcast_id string, turn_count int, turn_text string, start_time double, end_time double, speaker array<string>, inferred_speaker_role string",
    )
    tables = {"episode_catalog": episodes, "podcast": shows, "text": turns} | build.indexes(episodes, shows)
    return Corpus(spark, tables)


def ids(df, c="episode_id"):
    return sorted(r[c] for r in df.collect())


def test_lookups(corpus):
    assert ids(corpus.episode("e2")) == ["e2"] and corpus.episode("nowhere").isEmpty()
    assert [r.ep_title for r in corpus.episodes_of("p1").orderBy("position").collect()] == ["Second", "First"]
    assert [r.turn_count for r in corpus.turns_of("e1").collect()] == [0, 1, 2] and len(corpus) == 3
    assert corpus.has("p3") and not corpus.has("p9")
    assert [r.podcast_id for r in corpus.show_ids().collect()] == ["p1", "p2", "p3"]
    assert corpus.show("TALKS").first().podcast_id == "p1" and corpus.show(podcast_id="p2").first().pod_title == "Beta Hour"
    with pytest.raises(KeyError):
        corpus.turn_metrics_of("p9", "e1")
    with pytest.raises(FileNotFoundError):
        corpus.metrics_of("e1")


def test_restriction(corpus):
    some = corpus.restrict(["p2", "p9"])
    assert some.counts().first().asDict() == {"n_episodes": 1, "n_shows": 1} and ids(some.turns()) == ["e3"]
    assert some.catalog("episodes").count() == 3 and ids(some.shows_by_guest("bo"), "podcast_id") == ["p2"]


def test_searches(corpus):
    assert ids(corpus.search_episodes(podcast_name="alpha")) == []  # of shows with one title the last stands, which has no episodes
    assert ids(corpus.search_episodes(host_name="CY")) == ["e3"] and ids(corpus.search_episodes(category="arts", max_episodes=1)) == ["e1"]
    assert len(ids(corpus.search_episodes(2, "random", 7))) == 2
    assert ids(corpus.shows_by_category("ARTS"), "podcast_id") == ["p1"] and ids(corpus.shows_by_hostname("feeds.one.example"), "podcast_id") == ["p1"]
    assert ids(corpus.episodes_by_guest("bo")) == ["e1", "e3"] and ids(corpus.shows_by_host("ann", exact=True), "podcast_id") == ["p1"]
    assert {r.role for r in corpus.names("bo").collect()} == {"guest"}
    assert ids(corpus.search_turns("dog", "exact", role="guest")) == ["e1"] and ids(corpus.search_turns("the dog")) == ["e1", "e3"]
    assert [(r.episode_id, r.n_hits) for r in corpus.search_episodes_by_text("the", "exact").collect()] == [("e1", 2), ("e3", 1)]
    assert [(r.left, r.keyword, r.right) for r in corpus.concordance("of the", 1).collect()] == [("well", "of the", "running")]
    assert corpus.sql("SELECT count(*) AS n FROM turns JOIN podcasts USING (podcast_id)").first().n == 4
    with pytest.raises(TypeError):
        corpus.search_episodes(colour="red")
    with pytest.raises(ValueError):
        corpus.episodes_of_subcategory("nothing of the kind")


def test_frames(corpus):
    t = corpus.turns(["start_time"], strict=True)
    assert t.columns == ["start_time", "episode_id", "turn_count"] and t.count() == 3
    assert [r.day.isoformat() if r.day else None for r in corpus.episodes().orderBy("episode_id").collect()] == ["2023-11-14", None, None]
    with pytest.raises(ValueError, match="did you mean 'start_time'"):
        corpus.turns(["start_tim"])
    with pytest.raises(MemoryError):
        corpus.collected(corpus.turns(), "turns", most=10)
    with pytest.raises(MemoryError):
        windows.guarded_window_frame(corpus._text(), 2, most=10)
    assert len(corpus.collected(corpus.turns(), "turns")) == 4


def test_schema(spark):
    assert schema.resolve_table(" Metrics ") == "turns_metrics"
    with pytest.raises(ValueError, match="did you mean episodes"):
        schema.resolve_table("episods")
    assert {r.column for r in schema.describe(spark, grep="title").collect()} >= {"ep_title", "pod_title"}
    assert schema.describe(spark, "turn").count() == 12 and schema.row_bytes("turns", ["turn_text", "new"]) == 365
    df = spark.createDataFrame([("é", 1, None, [1]), (None, 2, None, None)], "turn_text string, turn_count int, odd string, `a.b` array<int>")
    met = {r.column: (r.type is None, r.found, r.n_rows, r.n_null, r.mean_width) for r in schema.measured(df, "turn").collect()}
    assert met["turn_text"] == (False, "string", 2, 1, 2.0) and met["turn_count"] == (False, "int", 2, 0, 4.0) and met["episode_id"] == (False, None, None, None, None)
    assert met["odd"] == (True, "string", 2, 2, None) and met["a.b"] == (True, "array<int>", 2, 1, 3.0) and len(met) == 14
    assert {r.n_rows for r in schema.measured(df.limit(0), "turn").collect()} == {0, None}
    assert {r.n_rows for r in schema.measured(df.select(), "turn").collect()} == {None}
    assert [schema.human_bytes(n) for n in (12, 1536, 3 << 30)] == ["12 B", "1.5 KB", "3.0 GB"]
    with pytest.raises(FileNotFoundError):
        schema.metadata_path(spark, "/nowhere", "episodes")


def test_stems():
    # examples of the paper
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor conflated conflat hopping hop filing file happy happi relational relat digitizer digit vietnamization vietnam hopefulness hope electrical electr replacement replac adoption adopt probate probat controll control"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2] and stem("éa") == "éa"


def test_parts_keep_filters_and_renames(spark, tmp_path):
    spark.range(200).selectExpr("id AS old", "id % 4 AS podcast_id").repartition(4).write.parquet(str(tmp_path / "t"))
    derived = spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("old", "id").where("id < 10").withColumn("twice", F.col("id") * 2)
    c = Corpus(spark, {"turns": derived})
    files = c.files("turns")
    assert [r.id * 2 == r.twice for r in c.table("turns", parts=[f.rsplit("/", 1)[-1] for f in files]).collect()] == [True] * 10
    each = [sorted(r.id for r in p.collect()) for p in c.chunks("text")]
    assert len(each) == len(files) and sorted(sum(each, [])) == list(range(10))
    assert c.table("turns", parts=["nowhere"]).isEmpty() and c.table("turns", parts=[]).isEmpty()
    one = c.table("turns", ["id"], parts=[files[0].rsplit("/", 1)[-1]])
    assert sorted(r.id for r in one.collect()) == each[0] and one.columns == ["id"]


def test_readers(spark, tmp_path):
    (tmp_path / "list").write_text("/z/one.rttm\n/a/one.rttm\n/a/two.txt\n")
    assert [tuple(r) for r in readers.read_paths(spark, str(tmp_path / "list"), ".rttm").collect()] == [("one", "/z/one.rttm")]
    (tmp_path / "w.csv").write_text("word,start,end,f0\na,2,1,x\nb,3,4,5\nc,,1,1\n")
    assert [tuple(r) for r in readers.read_words(spark, str(tmp_path / "w.csv"), ("f0",)).collect()] == [("a", 1.0, 2.0, None), ("b", 3.0, 4.0, 5.0)]
    (tmp_path / "s.json").write_text(json.dumps({"titles": ["x"]}))
    (tmp_path / "s.txt").write_text("# shows\n0123456789ab\n0123456789abcdef\nA title\n")
    assert readers.subset_of(str(tmp_path / "s.json")) == ([], [], ["x"])
    assert readers.subset_of(str(tmp_path / "s.txt")) == (["0123456789ab"], ["0123456789abcdef"], ["A title"])
    df = spark.range(10).withColumn("podcast_id", F.col("id") % 2)
    assert [readers.write_table(df, str(tmp_path / "t")) for _ in range(2)] == [0, 1]
    assert readers.read_table(spark, str(tmp_path / "t")).count() == 10
    df.write.partitionBy("podcast_id").parquet(str(tmp_path / "p"))
    readers.rename_columns(spark, str(tmp_path / "p"), str(tmp_path / "u"), {"id": "n"})
    readers.compact(spark, str(tmp_path / "u"), str(tmp_path / "v"), 1)
    assert len(spark.read.parquet(str(tmp_path / "v")).inputFiles()) == 1 and spark.read.parquet(str(tmp_path / "v")).columns == ["n", "podcast_id"]
    readers.write_shows(df, str(tmp_path / "s"))
    readers.write_row_map({"a": df, "b": df.where("id > 3")}, str(tmp_path / "m"))
    assert sorted((r.tree, r.podcast_id, r.num_rows) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", 0, 5), ("a", 1, 5), ("b", 0, 3), ("b", 1, 3)]
    made = json.loads(audit.manifest({"t": spark.read.parquet(str(tmp_path / "s"))}, "1"))["tables"]["t"]
    assert (made["rows"], made["podcasts"]) == (10, 2) and made["bytes"] > 0
    assert {p.count() for p in Corpus(spark, {"turns": spark.read.parquet(str(tmp_path / "s"))}).chunks()} == {5}


def test_best_parts(spark):
    index = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("y", "p1"), ("y", "p3"), ("z", "p2"), ("z", "p3")], "name_normalized string, podcast_id string")
    part = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "D")], "podcast_id string, part string")
    assert len(build.best_parts(index, part, 3)) == 3 and set(build.best_parts(index, part, 3)) == {"A", "B", "C"}


def test_best_of_many_parts(spark):
    shows = [(f"p{i}", f"part{i:02d}") for i in range(40)]
    index = [(f"g{i}", "p30") for i in range(9)] + [(f"g{i}", "p35") for i in range(9)] + [(f"h{i}", f"p{i}") for i in range(40)] + [(f"x{i}", p) for i in range(3) for p in ("p35", "p2")]
    args = (spark.createDataFrame(index, "name_normalized string, podcast_id string"), spark.createDataFrame(shows, "podcast_id string, part string"))
    assert build.best_parts(*args, 2) == ["part30", "part35"] and build.best_parts(*args, 3) == ["part02", "part30", "part35"]  # beyond the first nine
    assert len(build.best_parts(*args, 1)) == 1 and len(build.best_parts(*args, 50)) == 40


def test_blocks_of_a_hot_member(spark, monkeypatch):
    rows = [("hot", i) for i in range(30)] + [("a", 1), ("a", 2), ("a", 2), ("b", 5)]
    df = spark.createDataFrame(rows, "m string, g int")
    want = {(a, b): 1 for a in range(30) for b in range(a + 1, 30)}
    want[1, 2] = 2
    monkeypatch.setattr(network, "BLOCK", 7)
    assert {(r.a, r.b): r.weight for r in network.shared_pairs(df, "m", "g").collect()} == want


def test_mann_whitney_over_ranges(spark):
    import random

    r = random.Random(4)
    rows = [(r.randint(0, 40) / 2, r.random() < 0.4) for _ in range(500)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "v double, yes boolean"), "yes", "v").first()
    x, y = [v for v, yes in rows if yes], [v for v, yes in rows if not yes]
    assert float(got.u) == sum((a > b) + (a == b) / 2 for a in x for b in y) and (got.n1, got.n2) == (len(x), len(y))


def test_samples(spark):
    df = spark.range(1000)
    assert ids(catalog.seeded_rows(df, "id", 20, 1), "id") == ids(catalog.seeded_rows(df.repartition(7), "id", 20, 1), "id") != ids(catalog.seeded_rows(df, "id", 20, 2), "id")
    assert [r.id for r in catalog.iterate(df, "id", 3)] == [0, 1, 2] and len(list(catalog.iterate(df, "id", 3, "random"))) == 3


def test_flags(spark):
    df = spark.createDataFrame([(0.05, 0.1, 12.0, 2, 2), (None, 0.3, 1.0, 1, 2)], "o double, t double, d double, s int, l int")
    out = df.select(X.quality_score(*[F.col(c) for c in "otdsl"]).alias("q"), X.is_high_quality(F.col("o"), F.col("t")).alias("h"), X.overlap_grade(F.col("o")).alias("g")).collect()
    assert [tuple(r) for r in out] == [(4, True, "excellent"), (0, False, None)]
    assert frames.in_turn_order(df).columns == df.columns


def test_columns_of_the_registry(spark):
    from parlance.__main__ import parser, run

    out = run(spark, parser().parse_args(["columns", "turn", "--grep", "seconds"]))
    assert out[0].startswith("table\tcolumn") and [line.split("\t")[1] for line in out[1:]] == ["start_time", "end_time"]
    assert "episodes" in run(spark, parser().parse_args(["columns"]))
