"""The quality classifier on its held-out fold, and its edges."""

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import goodness


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    found = goodness.op12_goodness(spark, d)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    out = rows[rows.held_out & rows.quality.notna()]
    right = out.predicted == out.quality
    ranks = out.score.rank()
    auc = (ranks[out.quality == 1].mean() - ranks[out.quality == 0].mean()) / len(out) + 0.5
    assert right.mean() > 0.97 and right[out.quality == 1].mean() > 0.99 and right[out.quality == 0].mean() > 0.85 and auc > 0.98
    assert abs(out.score.mean() - out.quality.mean()) < 0.02 and ((out.score - out.quality) ** 2).mean() < 0.025  # calibrated


def train(rows):
    return goodness.train(rows.drop("good"), rows.select(F.col("doc_id").alias("l_id"), "good"))


def test_edges(spark):
    bad, good = "BUY!! NOW!! ### $$$ ", "a quiet sentence about the sea and its shores. "
    rows = [(i, (bad if i % 4 == 0 else good) * (i % 7 + 1) + str(i), i % 4 != 0) for i in range(80)]
    rows += [rows[0], rows[0], (900, None, True), (901, "", False), (902, "unlabelled", None), (None, "no id", True)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, good boolean").withColumns({"h": F.lit(0), "r": F.lit(1), "n": F.lit(2), "s_id": F.lit(3)}))
    docs = spark.createDataFrame([(1, bad * 5), (6, "".join(f"{bad}{i} " for i in range(40_000))), (2, good * 9), (2, good * 9), (3, None), (4, ""), (5, "ü" * 50)], "doc_id long, text string").withColumn("good", F.lit("kept"))
    out = goodness.score(docs, model).collect()
    by = {r.doc_id: r.score for r in out}
    assert len(out) == 7 and all(r.good == "kept" and 0 <= r.score <= 1 for r in out)
    assert by[1] < 0.5 < by[2] and by[3] == by[4]
    assert goodness.score(docs.limit(0), model).isEmpty()


def test_labels_of_one_class_or_none(spark):
    one = spark.createDataFrame([(1, "x", True)], "doc_id long, text string, good boolean")
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    for labelled, want in ((one, 1.0), (one.limit(0), 0.5), (one.withColumn("good", F.lit(False)), 0.0)):
        assert [r.score for r in goodness.score(docs, train(labelled)).collect()] == [want, want]


def test_two_labelled_rows_are_enough(spark):
    two = spark.createDataFrame([(1, "good text", True), (2, "$$$", False)], "doc_id long, text string, good boolean")
    assert all(0 <= r.score <= 1 for r in goodness.score(two.select("doc_id", "text"), train(two)).collect())


def test_curve_is_a_logistic_fit():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(4000), rng.normal(size=4000)]
    y = (rng.random(4000) < goodness.probability(x @ np.array([0.5, -1.5]))).astype(float)
    assert np.abs(goodness.curve(x, y, np.ones(4000)) - [0.5, -1.5]).max() < 0.2
