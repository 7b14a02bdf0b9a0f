"""Quality rules whose cutoffs follow the corpus: mergeable quantile sketches per language and source.

A sketch is a histogram over integer buckets with ten significant bits (relative error below 0.2 %): it merges by adding
counts, so Spark builds it map-side, and it gives the same quantiles on every run and in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import WORD, let, materialize, reserve, table

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measured rates: numerator, denominator, scale, and the distance (in scaled units) that is always allowed beyond the fence.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, 30),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 300),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, 250),
    "word_length": ("word_chars", "n_words", 100, 150),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The corpus counts as this many documents of every group, so the cutoffs of a group of n are its own by n / (n + PRIOR).
PRIOR = 100
FENCE = 3


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: sort (hash, place), keep equal neighbours, add up cover."""
    windows = let(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))))
    same = lambda s, x, k: F.get(s, k)["h"] == x["h"]
    repeated = let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, x, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same(s, x, F.greatest(k - 1, F.lit(0))), F.lit(False)))), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    cover = F.aggregate(F.sort_array(repeated), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.coalesce(cover, F.lit(0))


def with_stats(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (bigint), row by row.

    Null text counts as empty; texts of any length are read whole; input columns with these names are an error.
    """
    reserve(df, *STATS, "n_lines", "__stats", "__lines")
    t = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    stats = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = df.withColumn("__stats", stats).withColumn("__lines", lines).withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"))
    names = {"n_words": "__stats", "word_chars": "__stats", "n_repeat_words": "__stats", "n_lines": "__lines", "n_dup_lines": "__lines"}
    return out.withColumns({k: F.col(v)[k].cast("bigint") for k, v in names.items()}).drop("__stats", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(v: Column) -> Column:
    """The smallest number with the same ten leading bits."""
    low = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def rates() -> dict[str, Column]:
    return {k: F.expr(f"coalesce({scale} * {a} div nullif({b}, 0), 0)").cast("bigint") for k, (a, b, scale, _) in RATES.items()}


def sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, rate and bucket with n documents: at most a few thousand rows a group at any corpus size."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in rates().items()])
    return stats.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.rate", "p.bucket").groupBy(*keys, "rate", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: its documents n_group and lo_/hi_ of each rate, quartiles minus or plus FENCE interquartile ranges and the slack."""
    up = W.partitionBy(*keys, "rate").orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(W.partitionBy(*keys, "rate")))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    per = ranked.groupBy(*keys, "rate").agg(q(25).alias("q25"), q(75).alias("q75"), F.max("total").alias("total"))
    pick = lambda k, e: F.max(F.when(F.col("rate") == k, e))
    out = [F.max("total").alias("n_group")]
    for k, (*_, slack) in RATES.items():
        reach = FENCE * (F.col("q75") - F.col("q25")) + slack
        out += [pick(k, F.col("q25") - reach).alias(f"lo_{k}"), pick(k, F.col("q75") + reach).alias(f"hi_{k}")]
    return per.groupBy(*keys).agg(*out)


def quality_rules(stats: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds base_failed and kept to rows that with_stats has measured (pass a written table: it is read twice).

    Sketches take only documents that pass the base rules. A group's cutoffs are drawn towards the corpus's, the less the more
    documents it has: a rate r is met if (n + PRIOR) * r lies between n * own + PRIOR * corpus, at either end. Null keys form a group of their
    own. An empty table gives an empty result; repeated rows count as often as they occur; extra columns stay, but base_failed and
    kept are an error. Thresholds are one small row per group: they are written, so Spark broadcasts them only if their size on
    disk is below its limit.
    """
    reserve(stats, "base_failed", "kept")
    ks = list(keys)
    own = materialize(sketches(stats.where(~base_failed()), ks), "sketch")
    limits = [f"{e}_{k}" for k in RATES for e in ("lo", "hi")]
    corpus = thresholds(merge(own, []), []).select(F.struct(*limits)).scalar()
    blend = lambda c: (F.col("n_group") * F.col(c) + PRIOR * F.col("__all")[c]).alias(f"__{c}")
    group = thresholds(own, ks).withColumn("__all", corpus)
    both = materialize(group.select(*[F.col(c).alias(f"__{c}") for c in ks], (F.col("n_group") + PRIOR).alias("__weight"), *[blend(c) for c in limits]), "thresholds")
    met = F.lit(True)
    for k, v in rates().items():
        met = met & (v * F.col("__weight")).between(F.col(f"__lo_{k}"), F.col(f"__hi_{k}"))
    on = F.lit(True)
    for c in ks:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = stats.join(both, on, "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(met, F.lit(False))).select(*stats.columns, "base_failed", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = materialize(with_stats(docs).drop("text"), "quality")
    return quality_rules(stats).select("doc_id", *STATS, "base_failed", "kept")


_FENCES = ", ".join(f"max(CASE WHEN rate = '{k}' THEN q25 - 3 * (q75 - q25) - {s} END) AS lo_{k}, max(CASE WHEN rate = '{k}' THEN q75 + 3 * (q75 - q25) + {s} END) AS hi_{k}" for k, (*_, s) in RATES.items())
_TAKE = ", ".join(f"g.total * g.{e}_{k} + {PRIOR} * a.{e}_{k} AS {e}_{k}" for k in RATES for e in ("lo", "hi"))
_RATES = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, coalesce({sc} * {a} // nullif({b}, 0), 0) AS v FROM s WHERE NOT base_failed" for k, (a, b, sc, _) in RATES.items())
_MET = " AND ".join(f"weight * coalesce({sc} * {a} // nullif({b}, 0), 0) BETWEEN lo_{k} AND hi_{k}" for k, (a, b, sc, _) in RATES.items())


def _quartiles(keys: str) -> str:
    by = f"{keys}rate"
    return f"""SELECT {by}, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS q25, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS q75
FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
      FROM (SELECT {by}, bucket, count(*) AS n FROM b GROUP BY {by}, bucket)) GROUP BY {by}"""


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + o AS p FROM r, (VALUES (0), (1), (2)) AS v(o)) GROUP BY rid),
li AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN li USING (rid) LEFT JOIN rw USING (rid))),
b AS (SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) AS bucket FROM ({_RATES})),
qg AS ({_quartiles("lang, source, ")}), qa AS ({_quartiles("")}),
tg AS (SELECT lang, source, max(total) AS total, {_FENCES} FROM qg GROUP BY lang, source), ta AS (SELECT {_FENCES} FROM qa),
th AS (SELECT g.lang, g.source, g.total + {PRIOR} AS weight, {_TAKE} FROM tg g, ta a)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_MET}, false) AS kept
FROM s LEFT JOIN th ON s.lang IS NOT DISTINCT FROM th.lang AND s.source IS NOT DISTINCT FROM th.source
"""
