"""Versions of tables, and the index of row groups."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parlance.corpus import Corpus
from parlance.operators import build
from parlance.sources import footers, snapshots


def test_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, at)
    assert snapshots.commit(spark.range(3).withColumn("k", F.col("id") % 2), at, ("k",)) == 0
    old = snapshots.read(spark, at)
    assert snapshots.commit(spark.range(5).withColumn("k", F.lit(1)), at) == 1
    assert snapshots.commit(spark.range(2).withColumn("k", F.lit(7)), at, append=True) == 2
    assert [snapshots.read(spark, at, v).count() for v in snapshots.versions(spark, at)] == [3, 5, 7]
    assert sorted(r.id for r in old.collect()) == [0, 1, 2]  # a reader of before
    assert snapshots.read(spark, at).columns == ["id", "k"]
    gone = snapshots.vacuum(spark, at, keep=2)
    assert len(gone) == 1 and snapshots.versions(spark, at) == [1, 2] and snapshots.read(spark, at).count() == 7
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, at, 0)


def test_a_crash_between_the_steps(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    snapshots.commit(spark.range(3), at)
    lost = snapshots.write_data(spark.range(99), at)  # and the writer dies
    assert snapshots.read(spark, at).count() == 3
    with monkeypatch.context() as m:  # it dies with the manifest written, not yet published
        m.setattr(snapshots._Files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(spark.range(50), at)
    assert snapshots.versions(spark, at) == [0] and snapshots.read(spark, at).count() == 3
    assert snapshots.commit(spark.range(4), at) == 1 and snapshots.read(spark, at).count() == 4
    assert lost in snapshots.vacuum(spark, at)


def test_two_writers(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.commit(spark.range(1), at)
    name = snapshots.write_data(spark.range(9), at)
    snapshots.commit(spark.range(2), at)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, at, [name], 1, spark.range(1).schema.json())
    assert snapshots.read(spark, at).count() == 2


@pytest.fixture
def files(spark, tmp_path):
    """Four files of a tree in show order, one of which has a row group per show."""
    for i in range(4):
        rows = pa.table({"podcast_id": [f"p{(i * 50 + j) // 20:02d}" for j in range(50)], "n": list(range(50)), "ab": [1] * 50})
        pq.write_table(rows, tmp_path / f"part {i}.parquet", row_group_size=20, compression="zstd")
    pq.write_table(pa.table({"podcast_id": ["p50"] * 10, "n": list(range(10)), "ab": [1] * 10}), tmp_path / "part 9.parquet", row_group_size=4)
    return spark.read.parquet(str(tmp_path))


def test_row_groups(spark, files):
    groups = footers.row_groups(spark, files.inputFiles(), "podcast_id").cache()
    assert groups.count() == 4 * 3 + 3 and footers.total(groups) == 210 and {r.n_nulls for r in groups.collect()} == {0}
    assert [f.rsplit("/", 1)[-1] for f in footers.files_with(groups, "p50")] == ["part 9.parquet"] and footers.files_with(groups, "q") == []
    got = footers.lookup(spark, groups, "podcast_id", "p02", files.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, files.where("podcast_id = 'p02'").collect())) and len(got.inputFiles()) == 2
    want = sorted((r.podcast_id, r.part, r["count"]) for r in files.groupBy("podcast_id", F.replace(F.substring_index(F.input_file_name(), "/", -1), F.lit("%20"), F.lit(" ")).alias("part")).count().collect())
    assert sorted((r.podcast_id, r.part, r.num_rows) for r in footers.counts(spark, groups, "podcast_id", files.schema).collect()) == want
    told = {r.part: (r.n_rows, r.n_groups, r.there) for r in footers.coverage(groups, ["part 9.parquet", "nowhere", "nowhere"]).collect()}
    assert told == {"part 9.parquet": (10, 3, True), "nowhere": (0, 0, False)}


def test_numbers_and_nulls(spark, tmp_path):
    pq.write_table(pa.table({"k": [9, 10, 100]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": pa.array([None, None], pa.int64())}), tmp_path / "b.parquet")
    df = spark.read.parquet(str(tmp_path))
    groups = footers.row_groups(spark, df.inputFiles(), "k")
    assert [f[-9:] for f in footers.files_with(groups, 11, "bigint")] == ["a.parquet"] and footers.files_with(groups, 8, "bigint") == []
    assert sorted((r.k is None, r.k, r.num_rows) for r in footers.counts(spark, groups, "k", df.schema).collect() if r.k) == [(False, 9, 1), (False, 10, 1), (False, 100, 1)]
    assert footers.row_groups(spark, df.inputFiles(), "absent").where("least is not null").isEmpty() and footers.row_groups(spark, [], "k").isEmpty()


def test_look_ups_of_a_corpus_by_row_groups(spark, files, tmp_path):
    assert Corpus(spark, {"turns": files}).n_rows("turns") == 210
    groups = footers.row_groups(spark, files.inputFiles(), "podcast_id").cache()
    groups.count()
    c = Corpus(spark, {"turns": files}, groups={"turns": groups})
    for i in range(4):  # files that a look-up has no need to open
        (tmp_path / f"part {i}.parquet").write_bytes(b"x" * (tmp_path / f"part {i}.parquet").stat().st_size)
    one = c.of_show("turns", "p50", ["n"])
    assert one.columns == ["n"] and one.count() == 10 and c.n_rows("turns") == 210 and c.of_show("turns", "p99").isEmpty()


def test_renamed_files_keep_their_row_groups(spark, files, tmp_path):
    target = str(tmp_path / "renamed")
    done = footers.rename_columns(spark, files.inputFiles(), target, {"n": "number", "podcast_id": "show"}).collect()
    assert sum(r.n_rows for r in done) == 210
    before = {f"part {i}.parquet": pq.ParquetFile(tmp_path / f"part {i}.parquet").metadata for i in (0, 1, 2, 3, 9)}
    for name, meta in before.items():
        now = pq.ParquetFile(f"{target}/{name}").metadata
        assert [now.row_group(g).num_rows for g in range(now.num_row_groups)] == [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
        assert now.row_group(0).column(0).compression == meta.row_group(0).column(0).compression
    out = spark.read.parquet(target)
    assert out.columns == ["show", "number", "ab"] and sorted(map(tuple, out.collect())) == sorted(map(tuple, files.collect()))


def test_banded_trees(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 40)).alias("podcast_id"), F.col("id").alias("turn"))
    shows = spark.createDataFrame([(f"p{i}", f"c{i % 3}") for i in range(39)] + [("hot", "c1"), ("silent", "c0")], "podcast_id string, primary_category string")
    assert build.write_banded(rows, shows, str(tmp_path / "t"), ("turn",), 6) == 0
    out = snapshots.read(spark, str(tmp_path / "t"))
    want = rows.where("podcast_id <> 'p39'").join(build.bands(shows, rows.groupBy("podcast_id").agg(F.count("*").alias("weight")), 6), "podcast_id")
    assert sorted(map(tuple, out.select("podcast_id", "turn", "band").collect())) == sorted(map(tuple, want.select("podcast_id", "turn", "band").collect()))
    files = out.where("podcast_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1  # no task wrote all of the largest show
    for r in out.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("turn").alias("t"), F.collect_list("podcast_id").alias("p")).collect():
        assert list(zip(r.p, r.t)) == sorted(zip(r.p, r.t))


def test_tables_in_folders_are_one_part(spark, tmp_path):
    from parlance.plans import library

    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: sorted(map(tuple, library.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("q_shard_map") == [(f"s{i}", "documents", "documents.parquet", 20) for i in range(3)]
    assert run("q_footer_shard_map") == [(f"s{i}", "documents.parquet", 20) for i in range(3)]
    assert run("q_rows_of_parts") == [(i,) for i in range(60)]
    c = Corpus(spark, {"turns": spark.read.parquet(str(tmp_path / "documents.parquet"))})
    one = c.table("turns", parts=c.files("turns")[:1])  # a file of the folder is still a part
    assert 0 < one.count() < 60 and c.table("turns", parts=[f"file://{tmp_path}/documents.parquet"]).count() == 60
