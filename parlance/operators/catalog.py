"""Searches and statistics over catalogs of episodes and shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import names

CRITERIA = ("min_duration", "max_duration", "min_speakers", "max_speakers", "language", "podcast_id", "podcast_name", "category", "subcategory", "host_name", "guest_name", "min_overlap_prop_duration", "max_overlap_prop_duration")


def search_episodes(
    episodes: DataFrame,
    shows: DataFrame | None = None,
    categories: DataFrame | None = None,
    hosts: DataFrame | None = None,
    guests: DataFrame | None = None,
    limit: int | None = None,
    order: str = "episode_id",
    sampling: str = "first",
    seed: int = 0,
    position: str = "podcast_id",
    **criteria,
) -> DataFrame:
    """Episodes that meet every criterion; of these the first by `order`, or a random `limit`.

    A category is its show's, by substring; names go through their indexes, or without one through the episodes' own name lists. Of shows
    with one title, case apart, the last by `position` (a column of shows) stands for it.
    """
    if sampling not in ("first", "random"):
        raise ValueError(f"unknown sampling {sampling!r}")
    unknown = set(criteria) - set(CRITERIA)
    if unknown:
        raise TypeError(f"unknown criteria {sorted(unknown)}" + ("; limit is an argument of its own" if "max_episodes" in unknown else ""))
    out = episodes
    for name, column, low in (("min_duration", "duration_seconds", True), ("max_duration", "duration_seconds", False), ("min_speakers", "num_main_speakers", True), ("max_speakers", "num_main_speakers", False), ("min_overlap_prop_duration", "overlap_prop_duration", True), ("max_overlap_prop_duration", "overlap_prop_duration", False)):
        if criteria.get(name) is not None:
            out = out.where(F.col(column) >= criteria[name] if low else F.col(column) <= criteria[name])
    if criteria.get("language"):
        out = out.where(F.lower("language") == criteria["language"].lower())
    if criteria.get("podcast_id") is not None:
        out = out.where(F.col("podcast_id") == criteria["podcast_id"])
    if criteria.get("podcast_name"):
        last = shows.groupBy(F.lower("pod_title").alias("t")).agg(F.max_by("podcast_id", position).alias("podcast_id"))
        out = out.join(last.where(F.contains("t", F.lit(criteria["podcast_name"].lower()))), "podcast_id", "left_semi")
    for name in ("category", "subcategory"):
        if criteria.get(name):
            out = out.join(categories.where(F.contains(F.lower("category"), F.lit(criteria[name].lower()))), "podcast_id", "left_semi")
    for name, index, column in (("host_name", hosts, "host_predicted_names"), ("guest_name", guests, "guest_predicted_names")):
        if criteria.get(name) and index is None:
            out = out.where(holds_name(F.col(column), criteria[name]))
        elif criteria.get(name):
            out = out.join(index.where(F.contains("name_normalized", F.lit(criteria[name].strip().lower()))), "episode_id", "left_semi")
    if limit is None:
        return out
    return random_rows(out, limit, seed) if sampling == "random" else out.orderBy(order).limit(limit)


def holds_name(names: Column, name: str) -> Column:
    """Whether any name of a list holds this one, case and edge white space apart."""
    q = F.lit(name.strip().lower())
    return F.coalesce(F.exists(names, lambda n: F.contains(F.lower(n), q)), F.lit(False))


def random_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, others for another seed; a top-k of random numbers, so that no task holds all rows."""
    return rows.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def seeded_rows(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that depend on their keys and the seed only, not on order or partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def iterate(rows: DataFrame, order: str, limit: int | None = None, sampling: str = "first", seed: int = 0):
    """Rows one after another, fetched a partition at a time."""
    some = rows.orderBy(order) if limit is None else random_rows(rows, limit, seed) if sampling == "random" else rows.orderBy(order).limit(limit)
    return some.toLocalIterator()


def episodes_of_show(episodes: DataFrame, podcast_id, known_subcategories: tuple[str, ...] | None = None, **where) -> DataFrame:
    """Episodes of a show by host, guest (exact names), category (exact), subcategory (one that is known), title (case apart), and
    ranges (low, high; None is open) of minutes, speakers and dates (timestamps, inclusive)."""
    out = episodes if podcast_id is None else episodes.where(F.col("podcast_id") == podcast_id)
    unknown = set(where) - {"host", "guest", "category", "subcategory", "title", "minutes", "speakers", "dates"}
    if unknown:
        raise TypeError(f"unknown criteria {sorted(unknown)}")
    for name, column in (("host", "host_predicted_names"), ("guest", "guest_predicted_names"), ("category", "categories")):
        if name in where:
            out = out.where(F.array_contains(column, where[name]))
    if "subcategory" in where:
        ok = known_subcategories is None or where["subcategory"] in known_subcategories
        out = out.where(F.array_contains("categories", where["subcategory"]) if ok else F.lit(False))
    if "title" in where:
        out = out.where(F.lower("ep_title") == where["title"].lower()).orderBy("episode_id").limit(1)
    for name, value in (("minutes", F.col("duration_seconds") / 60), ("speakers", F.col("num_main_speakers"))):
        low, high = where.get(name, (None, None))
        out = out if low is None else out.where(value >= low)
        out = out if high is None else out.where(value <= high)
    if "dates" in where:
        low, high = (None if x is None else F.lit(x) for x in where["dates"])
        at = X.millis_timestamp(F.col("episode_date"))
        out = out if low is None else out.where(at >= low)
        out = out if high is None else out.where(at <= high)
    return out


def shows_by_category(shows: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """Shows of a category: equality, case apart (an episode search goes by substring)."""
    return shows.join(categories.where(F.lower("category") == category.lower()).select("podcast_id").distinct(), "podcast_id", "left_semi")


def shows_by_hostname(shows: DataFrame, hostnames: DataFrame, hostname: str) -> DataFrame:
    return shows.join(hostnames.where(F.col("hostname") == hostname).select("podcast_id").distinct(), "podcast_id", "left_semi")


def shows_by_name(shows: DataFrame, index: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Shows of a host or guest by the show-grained index."""
    return shows.join(names.lookup(index, name, exact).select("podcast_id").distinct(), "podcast_id", "left_semi")


def episodes_by_name(episodes: DataFrame, index: DataFrame, name: str, exact: bool = False, limit: int | None = None) -> DataFrame:
    """Episodes of a host or guest by the episode-grained index."""
    out = episodes.join(names.lookup(index, name, exact).select("episode_id").distinct(), "episode_id", "left_semi")
    return out if limit is None else out.orderBy("episode_id").limit(limit)


def category_index(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """category, podcast_id: each once, blanks skipped."""
    each = episodes.select("podcast_id", F.explode(F.array(*columns)).alias("c")).select(F.trim("c").alias("category"), "podcast_id")
    return each.where("category <> ''").distinct()


def hostname_index(shows: DataFrame, url: str = "rss_url") -> DataFrame:
    """hostname, podcast_id of feeds whose address has a host."""
    return shows.select(X.host_name(F.col(url)).alias("hostname"), "podcast_id").where("hostname <> ''").distinct()


def filter_by_metrics(metrics: DataFrame, limit: int = 10_000, order: str = "episode_id", **ranges: tuple) -> DataFrame:
    """Rows with every named metric in its (low, high); None is open."""
    out = metrics
    for name, (low, high) in ranges.items():
        if low is not None:
            out = out.where(F.col(name) >= low)
        if high is not None:
            out = out.where(F.col(name) <= high)
    return out.orderBy(order).limit(limit)


def find_show(shows: DataFrame, title: str, order: str = "podcast_id") -> DataFrame:
    """The show whose title is this, case apart; else the first that holds it."""
    low = F.lower("pod_title")
    hits = shows.where(F.contains(low, F.lit(title.lower())))
    return hits.orderBy(F.desc(low == title.lower()), order).limit(1)


def corpus_statistics(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count_distinct("podcast_id").alias("n_shows"), F.count("*").alias("n_episodes"), F.round(F.sum("duration_seconds") / 3600, 4).alias("hours"), F.round(F.avg("duration_seconds") / 60, 4).alias("mean_minutes"))


def category_distribution(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """Episodes by category over all category columns, trimmed, blanks skipped."""
    each = episodes.select(F.explode(F.array(*columns)).alias("c")).select(F.trim("c").alias("category"))
    return each.where("category <> ''").groupBy("category").agg(F.count("*").alias("n"))


def top_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a task before it shuffles."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def fold_tail(counts: DataFrame, name: str, n: str, keep: int = 7, other: str = "Other") -> DataFrame:
    """All but the `keep` largest as one."""
    ranked = counts.withColumn("r", F.row_number().over(W.orderBy(F.desc(n), name)))  # rows here are categories
    return ranked.groupBy(F.when(F.col("r") <= keep, F.col(name)).otherwise(other).alias(name)).agg(F.sum(n).alias(n))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """value, n of the values that are not null: languages, say, or numbers of speakers."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))


def corpus_profile(episodes: DataFrame, categories: list[str]) -> DataFrame:
    """measure, value, n: categories, languages and numbers of speakers of all episodes in one table."""
    parts = [category_distribution(episodes, categories).withColumnRenamed("category", "value")] + [histogram(episodes, c) for c in ("language", "num_main_speakers")]
    out = None
    for name, part in zip(("category", "language", "speakers"), parts, strict=True):
        one = part.select(F.lit(name).alias("measure"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def compare_categories(episodes: DataFrame, names_: list[str]) -> DataFrame:
    """Episodes and mean minutes of some categories."""
    return episodes.where(F.col("category").isin(*names_)).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("duration_seconds") / 60, 4).alias("mean_minutes"))


def show_properties(episodes: DataFrame, mains: tuple[str, ...] = ()) -> DataFrame:
    """Per show: sorted hosts, guests, categories, and those that are main or sub categories; first and last date; mean minutes."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    at = X.millis_timestamp(F.col("episode_date"))
    per = episodes.groupBy("podcast_id").agg(
        flat(F.col("host_predicted_names")).alias("hosts"),
        flat(F.col("guest_predicted_names")).alias("guests"),
        flat(F.col("categories")).alias("categories"),
        F.min(at).alias("earliest"),
        F.max(at).alias("latest"),
        F.round(F.avg("duration_seconds") / 60, 4).alias("mean_minutes"),
    )
    main = F.lit(list(mains)) if mains else F.array().cast("array<string>")
    return per.withColumn("main_categories", F.array_intersect("categories", main)).withColumn("subcategories", F.array_except("categories", main))


def show_distribution(episodes: DataFrame) -> DataFrame:
    """podcast_id, measure, value, n: kinds of episodes, categories and numbers of speakers of every show."""
    kinds = X.episode_kind(F.size("host_predicted_names"), F.size("guest_predicted_names"), F.col("duration_seconds"))
    pair = lambda m, v: F.struct(F.lit(m).alias("measure"), v.alias("value"))
    flags = [F.when(c, pair("kind", F.lit(k.removeprefix("is_")))) for k, c in kinds.items()]
    lists = F.transform("categories", lambda c: pair("category", c))
    each = F.array_compact(F.concat(F.array(*flags, pair("speakers", F.col("num_main_speakers").cast("string"))), lists))
    return episodes.select("podcast_id", F.explode(each).alias("x")).select("podcast_id", "x.*").groupBy("podcast_id", "measure", "value").agg(F.count("*").alias("n"))


def by_date(episodes: DataFrame) -> DataFrame:
    """Adds position: an episode's place in its show by date (unknown dates first), then title."""
    order = W.partitionBy("podcast_id").orderBy(F.coalesce(X.millis_timestamp(F.col("episode_date")), F.timestamp_millis(F.lit(0).cast("bigint"))), "ep_title", "episode_id")
    return episodes.withColumn("position", F.row_number().over(order) - 1)


def show_rollup(episodes: DataFrame) -> DataFrame:
    """Per show: count, total, categories, first and modal category, shortest and longest episode, span of dates."""
    modes = episodes.groupBy("podcast_id", "category").agg(F.count("*").alias("n"), F.min("episode_id").alias("first"))
    modal = modes.groupBy("podcast_id").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("modal_category"))
    per = episodes.groupBy("podcast_id").agg(
        F.count("*").alias("n_episodes"),
        F.sum("duration_seconds").alias("total_duration"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.min("category").alias("catalog_primary_category"),
        F.min_by("episode_id", F.struct("duration_seconds", "episode_id")).alias("shortest"),
        F.max_by("episode_id", F.struct("duration_seconds", -F.col("episode_id"))).alias("longest"),
    )
    return per.join(modal, "podcast_id")


def show_statistics(episodes: DataFrame) -> DataFrame:
    m = F.col("duration_seconds") / 60
    return episodes.groupBy("podcast_id").agg(F.round(F.min(m), 4).alias("min_minutes"), F.round(F.max(m), 4).alias("max_minutes"), F.round(F.median(m), 4).alias("median_minutes"), F.round(F.avg(m), 4).alias("mean_minutes"), F.count_if(F.col("duration_seconds") > 1800).alias("n_long"), F.count_if(F.col("duration_seconds") < 600).alias("n_short"))


def sample_shows(episodes: DataFrame, at_least: int, order) -> DataFrame:
    """Whole shows in the given order until they hold at least so many episodes."""
    per = episodes.groupBy("podcast_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(order, "podcast_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # rows here are shows
    return per.withColumn("before", before).where(F.col("before") < at_least).select("podcast_id", "n")
