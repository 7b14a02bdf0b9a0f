"""From raw feeds, words and speaker segments to the corpus' tables: each step a plan from tables to tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import snapshots
from ..sources.session import ensure_checkpoints
from . import catalog, frames, metrics, names, segments

CATEGORIES = [f"category{i}" for i in range(1, 11)]
# Fields of the raw records, and the columns they become.
EPISODE_FIELDS = {"epTitle": "ep_title", "mp3url": "mp3_url", "language": "language"}
SHOW_FIELDS = {"podTitle": "pod_title", "podDescription": "pod_description", "imageUrl": "image_url", "itunesAuthor": "itunes_author"}
FEATURES = {f"mfcc{i}_sma3Mean": f"mfcc{i}_sma3_mean" for i in range(1, 5)} | {"F0semitoneFrom27.5Hz_sma3nzMean": "f0_semitone_from_27_5hz_sma3nz_mean", "F1frequency_sma3nzMean": "f1_frequency_sma3nz_mean"}


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def ingest_episodes(records: DataFrame, order: str) -> DataFrame:
    """Raw episode records (with `order`, the line) to episodes: the first of each audio address, ids from the addresses, coerced values.

    Records without an audio or feed address go.
    """
    text = lambda n, default="": X.safe_text(_field(records, n), default)
    rows = records.withColumn("mp3_url", text("mp3url")).withColumn("rss_url", text("rssUrl")).where("mp3_url <> '' and rss_url <> ''")
    one = frames.keep_first(rows, ["mp3_url"], [order])
    cats = F.filter(F.array(*[X.safe_text(_field(records, c)) for c in CATEGORIES]), lambda c: c != "")
    return one.select(
        F.col(order).alias("line"),
        X.episode_id(F.col("mp3_url")).alias("episode_id"),
        X.show_id(F.col("rss_url")).alias("podcast_id"),
        text("epTitle").alias("ep_title"),
        "mp3_url",
        "rss_url",
        X.safe_number(_field(records, "durationSeconds")).alias("duration_seconds"),
        text("language", "en").alias("language"),
        X.safe_number(_field(records, "explicit"), "bigint").alias("explicit"),
        X.safe_list(_field(records, "hostPredictedNames")).alias("host_predicted_names"),
        X.safe_list(_field(records, "guestPredictedNames")).alias("guest_predicted_names"),
        X.safe_number(_field(records, "numMainSpeakers"), "bigint").alias("num_main_speakers"),
        _field(records, "episodeDateLocalized").cast("string").alias("episode_date"),
        cats.alias("categories"),
        *[text(k).alias(v) for k, v in SHOW_FIELDS.items()],
        text("transcript").alias("transcript"),
    )


def ingest_shows(episodes: DataFrame) -> DataFrame:
    """Shows of ingested episodes: counts, sums, sets and dates; descriptive columns are the first record's; the primary category is the first by alphabet."""
    at = X.millis_timestamp(F.col("episode_date"))
    first = lambda c: F.min_by(c, "line").alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return episodes.groupBy("podcast_id").agg(
        first("rss_url"),
        *[first(c) for c in SHOW_FIELDS.values()],
        first("language"),
        first("explicit"),
        F.count("*").alias("episode_count"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.try_element_at(union("categories"), F.lit(1)).alias("primary_category"),
        union("categories").alias("all_categories"),
        union("host_predicted_names").alias("host_names"),
        F.min(at).alias("earliest_date"),
        F.max(at).alias("latest_date"),
    )


def ingest_turns(records: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw turn records to (text, acoustics) of the episodes they belong to, by audio address; others go (see unmatched)."""
    known = episodes.select("mp3_url", "episode_id", "podcast_id")
    rows = records.withColumn("mp3_url", X.safe_text(_field(records, "mp3url"))).join(known, "mp3_url")
    number = lambda n, kind="double": X.safe_number(_field(records, n), kind)
    is_list = "speaker" in records.columns and records.schema["speaker"].dataType.typeName() == "array"
    text = rows.select(
        "episode_id",
        "podcast_id",
        X.as_list(_field(records, "speaker"), is_list).alias("speaker"),
        X.safe_text(_field(records, "turnText")).alias("turn_text"),
        number("startTime").alias("start_time"),
        number("endTime").alias("end_time"),
        number("duration").alias("duration"),
        number("turnCount", "int").alias("turn_count"),
        X.safe_text(_field(records, "inferredSpeakerRole")).alias("inferred_speaker_role"),
        X.safe_text(_field(records, "inferredSpeakerName")).alias("inferred_speaker_name"),
    )
    sound = rows.select("episode_id", "podcast_id", number("turnCount", "int").alias("turn_count"), *[number(k).alias(v) for k, v in FEATURES.items()])
    return text, sound


def unmatched(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """matched, unmatched: raw turn records with an audio address, by whether an episode has it."""
    url = X.safe_text(_field(records, "mp3url"))
    known = episodes.select(F.col("mp3_url").alias("k")).distinct()
    rows = records.select(url.alias("u")).where("u <> ''").join(known, F.col("u") == F.col("k"), "left")
    return rows.agg(F.count("k").alias("matched"), F.count_if(F.col("k").isNull()).alias("unmatched"))


def worklist(episodes: DataFrame, words: DataFrame, segments_: DataFrame) -> DataFrame:
    """Episodes of which both timed words and speaker segments exist (key, path), by the audio address without punctuation."""
    rows = episodes.select("episode_id", "podcast_id", X.url_key(F.col("mp3_url")).alias("key"), (F.coalesce("total_sp_labels", F.lit(0)) > 0).alias("had_turns"))
    side = lambda t, c: t.select("key", F.col("path").alias(c))
    return rows.join(side(words, "words_path"), "key").join(side(segments_, "segments_path"), "key").drop("key")


def turns_from_words(words: DataFrame, segments_: DataFrame, bucket: float = 30.0, features: tuple[str, ...] = ()) -> DataFrame:
    """Turns of episodes from words (episode_id, pos, word, w_start, w_end, features) and segments (episode_id, label, s_start, s_end).

    A word has the labels of the segments it overlaps, in the order in which these begin; turns are runs of words in file order
    with the same set of labels. A word without labels joins the run in progress, a leading one the first run; without any
    label the episode is one turn. speaker lists the labels as the run's first labelled word has them.
    """
    met = segments.interval_join(words.select("episode_id", "pos", "w_start", "w_end"), segments_, "episode_id", bucket)
    order = F.transform(F.array_sort(F.collect_list(F.struct("s_start", "s_end", "label"))), lambda x: x["label"])
    labels = met.groupBy("episode_id", "pos").agg(F.array_distinct(order).alias("labels"))
    rows = words.join(labels, ["episode_id", "pos"], "left").withColumn("key", F.array_join(F.array_sort("labels"), "\u0001"))
    rows = rows.withColumn("start", F.col("w_start")).withColumn("end", F.col("w_end"))
    runs = segments.islands(rows, "episode_id", ["pos"], "key")
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    stats = [x for c in features for x in (F.avg(clean(c)).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(clean(c)), F.lit(0.0)).alias(f"{c}_stdev"))]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    speaker = F.coalesce(F.min_by("labels", F.when(F.col("labels").isNotNull(), F.col("pos"))), F.array().cast("array<string>"))
    out = runs.groupBy("episode_id", F.col("run").cast("int").alias("turn_count")).agg(speaker.alias("speaker"), text.alias("turn_text"), F.min("start").alias("start_time"), F.max("end").alias("end_time"), F.count("*").alias("token_count"), *stats)
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def carryover(old: DataFrame, rebuilt: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Old turns of episodes that had labels (if their catalog is given) and were not rebuilt."""
    rows = old if episodes is None else frames.pin(old, episodes.where("total_sp_labels > 0"), "episode_id")
    return frames.without(rows, rebuilt, "episode_id")


def assembled_turns(rebuilt: DataFrame, old: DataFrame, known: DataFrame) -> DataFrame:
    """Rebuilt turns with restored names, and the old turns of other episodes, in one table; speakers_recomputed tells them apart."""
    new = names.restore_names(rebuilt, known).withColumn("speakers_recomputed", F.lit(True))
    rest = carryover(old, rebuilt).withColumn("speakers_recomputed", F.lit(False))
    return frames.aligned_union([new, rest], new)


def label_names(old: DataFrame) -> DataFrame:
    """(episode_id, label, name, label_role) of turns with an inferred speaker: the first seen for each label."""
    rows = old.where(~X.is_placeholder(F.col("speaker_name"))).select("episode_id", "turn_count", F.posexplode("speaker").alias("pos", "label"), F.col("speaker_name").alias("name"), F.col("role").alias("label_role"))
    one = rows.groupBy("episode_id", "label").agg(F.min_by(F.struct("name", "label_role"), F.struct("turn_count", "pos")).alias("f"))
    return one.select("episode_id", "label", "f.name", "f.label_role")


def rebuilt_catalog(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The episode catalog with what its turns say; num_main_speakers only where there were no labels before."""
    stats = metrics.episode_turn_stats(turns).withColumnsRenamed({c: f"new_{c}" for c in ("labels", "avg_turn_duration", "overlap_prop_turn_count", "overlap_prop_duration")})
    n = F.when(F.col("new_labels") == "", F.lit(0)).otherwise(F.size(F.split("new_labels", ","))).cast("bigint")
    both = episodes.join(stats, "episode_id", "left").withColumn("__n", F.when(F.col("new_labels").isNotNull(), n))
    had = F.coalesce(F.col("total_sp_labels"), F.lit(0)) > 0
    out = both.withColumn("num_main_speakers", F.when(had | F.col("__n").isNull(), F.col("num_main_speakers")).otherwise(F.col("__n")))
    for c in ("avg_turn_duration", "overlap_prop_turn_count", "overlap_prop_duration"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c) if c in episodes.columns else F.col(f"new_{c}"))
    return out.withColumn("total_sp_labels", F.coalesce("__n", "total_sp_labels")).select(*episodes.columns)


def indexes(episodes: DataFrame, shows: DataFrame, turns: DataFrame | None = None) -> dict[str, DataFrame]:
    """Name, category and host indexes of the corpus; names of guests are those of turns, if there are turns, not of the text."""
    each = lambda c, owner: names.name_index(episodes, c, owner)
    spelt = F.min("name_original").alias("name_original")
    by_show = lambda index: index.groupBy("name_normalized", "podcast_id").agg(spelt)
    hosts = each("host_predicted_names", ["podcast_id", "episode_id"])
    if turns is None:
        guests = each("guest_predicted_names", ["podcast_id", "episode_id"])
    else:
        said = turns.where((F.col("role") == "guest") & ~X.is_placeholder(F.col("speaker_name"))).groupBy("podcast_id", "episode_id").agg(F.collect_set("speaker_name").alias("n"))
        guests = names.name_index(said, "n", ["podcast_id", "episode_id"])
    both = hosts.withColumn("role", F.lit("host")).unionByName(guests.withColumn("role", F.lit("guest")))
    categories = episodes.select("podcast_id", F.explode("categories").alias("c")).select(F.trim("c").alias("category"), "podcast_id").where("category <> ''").distinct()
    return {"host_episode_index": hosts, "host_index": by_show(hosts), "guest_episode_index": guests, "guest_index": by_show(guests), "speaker_name_index": both, "category_index": categories, "hostname_index": catalog.hostname_index(shows)}


def resolved_subset(spec: tuple[list[str], list[str], list[str]], episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """(asked, kind, podcast_id) of a subset's shows, episodes and titles; podcast_id is null where nothing answers."""
    spark = episodes.sparkSession
    rows = [(x, k) for k, values in zip(("show", "episode", "title"), spec, strict=True) for x in values]
    asked = spark.createDataFrame(rows, "asked string, kind string").distinct()
    ids = shows.select("podcast_id").distinct()
    by_show = ids.select(F.lit("show").alias("kind"), F.col("podcast_id").alias("asked"), "podcast_id")
    by_episode = episodes.select(F.lit("episode").alias("kind"), F.col("episode_id").alias("asked"), "podcast_id").distinct()
    by_title = shows.select(F.lit("title").alias("kind"), F.lower("pod_title").alias("asked"), "podcast_id")
    known = by_show.unionByName(by_episode).unionByName(by_title)
    met = (F.col("a.kind") == F.col("k.kind")) & (F.when(F.col("a.kind") == "title", F.lower("a.asked")).otherwise(F.col("a.asked")) == F.col("k.asked"))
    return asked.alias("a").join(known.alias("k"), met, "left").select("a.asked", "a.kind", "k.podcast_id")


def subset(tables: dict[str, DataFrame], shows: DataFrame, diarized_only: bool = False) -> dict[str, DataFrame]:
    """All tables cut to some shows (podcast_id), consistently: tables without a show follow their episodes."""
    ids = shows.select("podcast_id").distinct()
    if diarized_only:
        ids = frames.pin(ids, tables["turns"])
    kept = frames.pin(tables["episodes"], ids)
    return {n: frames.pin(t, ids) if "podcast_id" in t.columns else frames.pin(t, kept, "episode_id") if "episode_id" in t.columns else t for n, t in tables.items()}


def bands(shows: DataFrame, weights: DataFrame, n: int = 64) -> DataFrame:
    """(podcast_id, band): contiguous bands of shows in the order of category and id, of about equal weight (podcast_id, weight).

    Shows are ranked within their category, after the sums of the categories before, so that no task holds them all.
    """
    key = F.struct(F.lower(F.coalesce("primary_category", F.lit(""))).alias("c"), F.col("podcast_id").alias("p"))
    rows = shows.select("podcast_id", key.alias("k")).join(weights, "podcast_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sums = rows.groupBy(F.col("k.c").alias("c")).agg(F.sum("weight").alias("w"))  # rows here are categories
    before = sums.withColumn("before", F.coalesce(F.sum("w").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("w").over(W.partitionBy(F.lit(0))))
    placed = rows.withColumn("c", F.col("k.c")).join(before.select("c", "before", "total"), "c")
    upto = F.coalesce(F.sum("weight").over(W.partitionBy("c").orderBy("podcast_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    return placed.select("podcast_id", F.least(F.lit(n - 1), F.floor(F.lit(n) * upto / F.greatest("total", F.lit(1)))).cast("int").alias("band"))


def guest_shows(index: DataFrame, not_guests: tuple[str, ...] = ()) -> DataFrame:
    """name_normalized, shows (sorted set) of guests other than those of a stop-list."""
    rows = index.where(~F.col("name_normalized").isin(*not_guests)) if not_guests else index
    return rows.groupBy("name_normalized").agg(F.array_sort(F.collect_set("podcast_id")).alias("shows"))


def best_parts(index: DataFrame, part_of: DataFrame, k: int, compared: int = 9) -> list[str]:
    """The k parts (podcast_id, part) that together hold the most guests with two shows; ties to the parts first by name.

    Up to `compared` parts every combination is compared, by the sets of parts that guests touch. Of more, the pair of parts that
    holds most guests comes first, then always the part that adds most: all parts are weighed in Spark each time, though the choice need
    not be the best of all. Only what is chosen reaches the driver.
    """
    own = index.select("name_normalized", "podcast_id").distinct().join(part_of, "podcast_id")
    per = own.groupBy("name_normalized", "part").agg(F.least(F.count_distinct("podcast_id"), F.lit(2)).alias("n"))
    parts = part_of.select("part").where("part is not null").distinct()
    few = [r["part"] for r in parts.orderBy("part").limit(compared + 1).collect()]
    if len(few) <= compared:
        sets = per.groupBy("name_normalized").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("held"))  # at most `compared` parts
        counts = [([(h["part"], h["n"]) for h in r["held"]], r["g"]) for r in sets.groupBy("held").agg(F.count("*").alias("g")).collect()]
        gain = lambda combo: sum(g for held, g in counts if sum(n for p, n in held if p in combo) >= 2)
        return list(max(itertools.combinations(few, min(k, len(few))), key=gain, default=()))
    ensure_checkpoints(index.sparkSession)
    per = per.checkpoint()
    single = per.where("n > 1").groupBy("part").agg(F.count("*").alias("g"))
    if k > 1:
        a, b = (per.where("n = 1").select("name_normalized", F.col("part").alias(x)) for x in "ab")  # guests of one show in each of two parts
        met = a.join(b, "name_normalized").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
        alone = lambda x: single.select(F.col("part").alias(x), F.col("g").alias(f"g{x}"))
        twice = per.where("n > 1")
        shared = twice.select("name_normalized", F.col("part").alias("a")).join(twice.select("name_normalized", F.col("part").alias("b")), "name_normalized").where("a < b").groupBy("a", "b").agg(F.count("*").alias("same"))
        rank = met.join(alone("a"), "a", "left").join(alone("b"), "b", "left").join(shared, ["a", "b"], "left")
        rank = rank.withColumn("g", F.col("both") + F.coalesce("ga", F.lit(0)) + F.coalesce("gb", F.lit(0)) - F.coalesce("same", F.lit(0)))
        top = [r["part"] for r in single.orderBy(F.desc("g"), "part").limit(2).collect()]
        pair = rank.orderBy(F.desc("g"), "a", "b").limit(1).collect()
        found = single.where(F.col("part").isin(*top)).agg(F.sum("g")).first()[0] or 0
        chosen = [pair[0]["a"], pair[0]["b"]] if pair and pair[0]["g"] >= found else top
    else:
        chosen = []
    while len(chosen) < k:
        held = per.where(F.col("part").isin(*chosen)).groupBy("name_normalized").agg(F.sum("n").alias("have"))
        rest = per.where(~F.col("part").isin(*chosen)).join(held, "name_normalized", "left")
        adds = F.count_if((F.coalesce("have", F.lit(0)) < 2) & (F.coalesce("have", F.lit(0)) + F.col("n") >= 2))
        best = parts.where(~F.col("part").isin(*chosen)).join(rest.groupBy("part").agg(adds.alias("g")), "part", "left").orderBy(F.desc(F.coalesce("g", F.lit(0))), "part").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["part"])
    return sorted(chosen)


def tutorial_shows(guests: DataFrame, episodes: DataFrame, sample: int, low: int = 3, high: int = 40, seed: int = 0) -> DataFrame:
    """Shows of guests that appear on two or more, and a seeded sample of others with `low` to `high` episodes."""
    repeat = guests.where(F.size("shows") > 1).select(F.explode("shows").alias("podcast_id")).distinct()
    sized = episodes.groupBy("podcast_id").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    rest = catalog.seeded_rows(frames.without(sized, repeat), "podcast_id", sample, seed).select("podcast_id")
    return repeat.select("podcast_id", F.lit("repeat guest").alias("why")).unionByName(rest.select("podcast_id", F.lit("sample").alias("why")))


def claimed_and_heard(episodes: DataFrame) -> DataFrame:
    """(episode_id, name, heard): guests that the text names, and whether a label bears the name (guest_speaker_labels, JSON)."""
    heard = F.transform(F.coalesce(F.map_keys(X.json_map(F.col("guest_speaker_labels"))), F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    each = episodes.select("episode_id", heard.alias("heard"), F.explode("guest_predicted_names").alias("n")).withColumn("name", X.normalized_name(F.col("n")))
    return each.where("name <> ''").groupBy("episode_id", "name").agg(F.max(F.array_contains("heard", F.col("name"))).alias("heard"))


def write_banded(df: DataFrame, shows: DataFrame, path: str, order: tuple[str, ...], n: int = 64, rows_per_file: int = 2_000_000) -> int:
    """Rows of shows as a table's next version: a folder per band, its files in the order of show and `order`. Returns the version.

    Bands weigh what the rows of their shows are; rows of a show that the catalog has not are in none and stay out. Rows are
    ranged by band, show and order, so a show larger than a task's share is written by several, and readers of a show skip the other
    bands by folder and the other row groups by their ranges.
    """
    weights = df.groupBy("podcast_id").agg(F.count("*").alias("weight"))
    placed = df.join(bands(shows, weights, n), "podcast_id")
    keys = ["band", "podcast_id", *order]
    ranged = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return snapshots.commit(ranged, path, ("band",), options={"maxRecordsPerFile": rows_per_file})
