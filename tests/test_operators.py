"""Cases from definitions: traps of the data model, windows against a per-episode brute force, readers."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import exprs as X
from parlance.operators import catalog, frames, metrics, names, network, segments, windows
from parlance.sources import readers

TURN = "episode_id int, turn_count int, start_time double, end_time double, turn_text string, role string, speaker array<string>, word_count bigint"


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for i in range(30):
        st = {7: 8, 8: 7}.get(i, i) * 10.0
        role = {0: "host", 1: "guest"}.get(i % 5, "NO_INFERRED_ROLE")
        text = "  " if i == 12 else f"turn {i}"
        speaker = ["A", "B"] if i == 3 else [] if i == 4 else ["AB"[i % 2]]
        rows.append((1, i, st, st if i == 20 else st + 9, text, role, speaker, len(text.split())))
    return spark.createDataFrame(rows, TURN)


def brute(n, size, overlap, partial=False):
    step, out, k = size - overlap, [], 0
    if n <= size:
        return [list(range(n))]
    while k + size <= n or partial and k + overlap < n:
        out.append(list(range(k, min(n, k + size))))
        k += step
    return out


def test_populations(turns):
    assert turns.count() == 30 and frames.strict_turns(turns).count() == 28


@pytest.mark.parametrize("size,overlap", [(12, 6), (7, 0), (30, 0), (4, 3), (5, 1), (1, 0), (40, 2)])
def test_windows(turns, size, overlap):
    order = [r.turn_count for r in turns.orderBy("start_time", "turn_count").collect()]
    for partial in (False, True):
        got: dict = {}
        for r in windows.assign_windows(turns, size, overlap, partial=partial).collect():
            got.setdefault(r.window_index, []).append((r.pos, r.turn_count))
        want = brute(30, size, overlap, partial)
        assert [[t for _, t in sorted(got[k])] for k in sorted(got)] == [[order[i] for i in w] for w in want]


def test_window_sizes(turns):
    count = lambda *a, **k: windows.window_frame(turns, *a, **k).count()
    assert count(12, 6) == 4 and count(7) == 4 and count(7, partial=True) == 5
    one = windows.window_frame(turns, 30).first()
    assert (one.n_speakers, one.host_turns, one.guest_turns) == (2, 6, 6)
    with pytest.raises(ValueError):
        windows.window_frame(turns, 4, 4)


def test_time_windows(spark):
    rng = random.Random(3)
    rows = []
    for e in range(12):
        t = 0.0
        for i in range(rng.randint(1, 20)):
            t += rng.choice([0, 5, 40])
            rows.append((e, i, t, t + rng.choice([0.5, 3, 25]), "x", "host", ["A"], 1))
    df = spark.createDataFrame(rows, TURN)
    for dur, over in ((30.0, 0.0), (30.0, 10.0), (10.0, 5.0)):
        got = {(r.episode_id, r.window_index): r.n_turns for r in windows.time_window_frame(df, dur, over).collect()}
        want, step = {}, dur - over
        for e in range(12):
            own = [r for r in rows if r[0] == e]
            total = max(r[3] for r in own)
            for k in range(max(1, int((total - dur) // step) + 1)):
                want[e, k] = sum(r[2] < k * step + dur and r[3] > k * step for r in own)
        assert got == want


def test_turn_metrics_follow_last_positive_end(spark):
    rows = [(1, 0, 0.0, 4.0, "um so well", "host", ["A"], 3), (1, 1, 3.0, 5.0, None, "guest", ["B"], 0), (1, 2, 7.0, 7.0, "uh huh", "co-host", [], 2)]
    got = {r.turn_count: r for r in metrics.turn_metrics(spark.createDataFrame(rows, TURN)).collect()}
    assert (got[0].gap_from_prev, got[0].discourse_marker_count) == (None, 3)
    assert (got[1].gap_from_prev, got[1].overlap_with_prev, got[1].word_count) == (0.0, 1.0, 0)
    assert (got[2].gap_from_prev, got[2].words_per_second, got[2].discourse_marker_count) == (2.0, 0.0, 1)
    e = metrics.episode_metrics(metrics.turn_metrics(spark.createDataFrame(rows, TURN))).first()
    assert e.host_turn_count == 2 and e.unique_speaker_count == 2 and e.speaking_rate_host == 1.25


def test_left_join_neither_loses_nor_doubles(spark, turns):
    side = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 3, 7)], "episode_id int, turn_count int, word_count int")
    out = frames.left_join_side(turns, side, ["episode_id", "turn_count"])
    assert out.count() == 30 and out.where("word_count_metrics is not null").count() == 2


def test_projection_errors(turns):
    with pytest.raises(ValueError, match="turn_text"):
        frames.checked_columns(turns, ["turn_txt"])
    with pytest.raises(ValueError):
        frames.checked_columns(turns, [])
    with pytest.raises(TypeError, match="limit"):
        catalog.search_episodes(turns, max_episodes=3)


def test_placeholders(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "NO_INFERRED_SPEAKER", "speaker_07", "Ann", "SPEAKER_UNKNOWN")], "n string")
    assert [r.n for r in df.where(~X.is_placeholder(F.col("n"))).collect()] == ["Ann"]


def test_safe_list_and_names(spark):
    df = spark.createDataFrame([(1, '[" Ann ","ANN",""]'), (2, "Bo"), (3, "SPEAKER_DATA_UNAVAILABLE"), (4, None)], "owner int, n string")
    idx = names.name_index(df.withColumn("n", X.safe_list(F.col("n"))), "n", ["owner"])
    assert {(r.name_normalized, r.owner, r.name_original) for r in idx.collect()} == {("ann", 1, " Ann "), ("bo", 2, "Bo")}
    assert names.lookup(idx, "AN").count() == 1 and names.lookup(idx, "an", exact=True).count() == 0


def test_islands_leading_and_inner_gaps(spark):
    rows = [(1, i, k) for i, k in enumerate([None, "a", None, "a", "b", None, "a"])] + [(2, 0, None)]
    got = segments.islands(spark.createDataFrame(rows, "g int, i int, k string"), "g", ["i"], "k").orderBy("g", "i").collect()
    assert [(r.k, r.run) for r in got] == [("a", 0)] * 4 + [("b", 1)] * 2 + [("a", 2), (None, 0)]


def test_interval_join_no_repeats(spark):
    rng = random.Random(1)
    w = [(1, i, s := rng.uniform(0, 500), s + rng.uniform(0.1, 200)) for i in range(60)]
    g = [(1, i, s := rng.uniform(0, 500), s + rng.uniform(0.1, 90)) for i in range(60)]
    a, b = spark.createDataFrame(w, "g int, w int, w_start double, w_end double"), spark.createDataFrame(g, "g int, s int, s_start double, s_end double")
    got = sorted((r.w, r.s) for r in segments.interval_join(a, b, "g", 40.0).collect())
    assert got == sorted((x[1], y[1]) for x in w for y in g if y[2] < x[3] and y[3] > x[2])


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    assert {r.component for r in network.components(e).collect()} == {0, 100}


def test_readers(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 0.5 1.5 <NA> <NA> A <NA>\nLEXEME f 1 0 1 x x B\nSPEAKER short\n")
    assert [(r.start, r.end, r.label) for r in readers.read_rttm(spark, str(tmp_path / "a.rttm")).collect()] == [(0.5, 2.0, "A")]
    (tmp_path / "w.csv").write_text("word,start,end\nhi,2.0,1.0\nno,,\n")
    assert [(r.word, r.start, r.end) for r in readers.read_words(spark, str(tmp_path / "w.csv")).collect()] == [("hi", 1.0, 2.0)]
    (tmp_path / "j.json").write_text('{"a": 1}\nnot json\n')
    from pyspark.sql import types as T

    assert readers.read_jsonl(spark, str(tmp_path / "j.json"), T.StructType([T.StructField("a", T.LongType())])).count() == 1
    readers.write_tree(spark.range(100), str(tmp_path / "tree"), ["id"], 4)
    assert spark.read.parquet(str(tmp_path / "tree")).count() == 100


def test_phones(spark):
    df = spark.createDataFrame([(["K", "AO2", "F", "IY1"],), (["AH0"],), (["K"],)], "p array<string>")
    assert [r.v for r in df.select(X.vowel_index(F.col("p")).alias("v")).collect()] == [3, 0, None]


def test_stream_counts_equal_batch(spark, tmp_path):
    from parlance.streaming import turns as stream

    events = readers.table(spark, "/root/testdata/sf0.001", "events")
    live = stream.windowed_counts(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event*.parquet"))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_counts").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    want = stream.windowed_counts(events)
    assert spark.table("live_counts").exceptAll(want).isEmpty() and want.exceptAll(spark.table("live_counts")).isEmpty()
