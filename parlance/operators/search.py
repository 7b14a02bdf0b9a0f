"""Turn-text search: substring, regular expression, term counts, BM25, concordance, word positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.phrases import shared_phrases
from ..sources.session import ensure_checkpoints, settled
from .index import TextIndex, idf, query_terms, saturated, term_list
from .trigrams import TrigramIndex
from .weights import term_weights

MODES = ("fts", "exact", "regex")


def scan(turns: DataFrame, query: str, mode: str = "fts", text: str = "turn_text") -> DataFrame:
    """Turns that match, with score: occurrences of all terms (fts), or 1. Literal substrings; regex is case-sensitive."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    low = F.lower(text)
    if mode == "exact":
        return turns.where(F.contains(low, F.lit(query.lower()))).withColumn("score", F.lit(1.0))
    if mode == "regex":
        return turns.where(F.col(text).rlike(query)).withColumn("score", F.lit(1.0))
    out, score = turns, F.lit(0)
    for term in query.lower().split():
        out = out.where(F.contains(low, F.lit(term)))
        score = score + F.expr(f"(length(lower({text})) - length(replace(lower({text}), '{term.replace(chr(39), chr(39) * 2)}', ''))) div {len(term)}")
    return out.withColumn("score", score.cast("double"))


def select_turns(turns: DataFrame, podcast_id=None, episode_id=None, role: str | None = None) -> DataFrame:
    """Turns of a show, an episode, or a role: filters that a search applies before it ranks."""
    for column, value in (("podcast_id", podcast_id), ("episode_id", episode_id), ("role", role)):
        turns = turns if value is None else turns.where(F.col(column) == value)
    return turns


def search_turns(turns: DataFrame, query: str, mode: str = "fts", limit: int = 100, offset: int = 0, index: TextIndex | None = None, trigrams: TrigramIndex | None = None, some_turns: bool = False, **where) -> DataFrame:
    """The best turns with their text, ranked before they are joined: only the page's keys meet the text.

    With an index of the turns (by episode_id, turn_count), fts ranks by BM25 over all that it holds, whatever the filters; without one, by
    occurrences. some_turns: turns are not all that the index holds. With a trigram index, exact and regex verify only the turns
    that it cannot rule out.
    """
    keys, some = ["episode_id", "turn_count"], select_turns(turns, **where)
    if mode == "fts" and index is not None:
        among = some.select(*keys) if some_turns or any(v is not None for v in where.values()) else None
        best = page(index.best(query, limit + offset, among), keys, limit, offset)
    else:
        met = trigrams.candidates(some, query, mode) if trigrams is not None and mode != "fts" else some
        best = page(scan(met, query, mode).select(*keys, "score"), keys, limit, offset)
    return some.join(F.broadcast(best), keys)  # `limit` rows


def episodes_by_text(turns: DataFrame, query: str, mode: str = "fts", limit: int | None = 100, index: TextIndex | None = None, some_turns: bool = False) -> DataFrame:
    """Episodes with hits: how many, and the best score; best first (fts), or most hits first; all of them without a limit."""
    if mode == "fts" and index is not None:
        hits = index.scores(query)
        hits = hits.join(turns.select("episode_id", "turn_count"), ["episode_id", "turn_count"], "left_semi") if some_turns else hits
    else:
        hits = scan(turns, query, mode)
    first, second = ("best_score", "n_hits") if mode == "fts" else ("n_hits", "best_score")
    found = episode_hits(hits)
    return found if limit is None else found.orderBy(F.desc(first), F.desc(second), "episode_id").limit(limit)


def word_tokens(turns: DataFrame, episodes: DataFrame, word: str, longest: float | None = 30.0, limit: int | None = 50) -> DataFrame:
    """Turns with a whole word, no longer than `longest` seconds, with their episode's audio address: what a phonetic analysis fetches."""
    whole = rf"(?i)\b{re.escape(word)}\b"
    hits = scan(turns, word, "exact").where(F.col("turn_text").rlike(whole))
    if longest is not None:
        hits = hits.where(F.col("end_time") - F.col("start_time") <= longest)
    hits = hits if limit is None else hits.orderBy("episode_id", "turn_count").limit(limit)
    return hits.join(episodes.select("episode_id", "mp3_url"), "episode_id")


def entity_mentions(turns: DataFrame, extract, text: str = "turn_text") -> DataFrame:
    """(episode_id, turn_count, entity) of what `extract`, a Spark function from text to a list of names, finds; squashed, once a turn."""
    each = turns.select("episode_id", "turn_count", F.explode(extract(F.col(text))).alias("name"))
    return each.select("episode_id", "turn_count", X.squashed_entity(F.col("name")).alias("entity")).where("entity <> ''").distinct()


def page(hits: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Best first, ties by key: a top-k per partition, then of those."""
    return hits.orderBy(F.desc("score"), *keys).offset(offset).limit(limit)


def episode_hits(hits: DataFrame, key: str = "episode_id") -> DataFrame:
    return hits.groupBy(key).agg(F.count("*").alias("n_hits"), F.max("score").alias("best_score"))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score of the documents with any term, without an index; the mean length is over documents with terms.

    Documents are scanned once for their length and counts of the query's terms, which are written as narrow rows; statistics are
    one row. For repeated searches write an index.
    """
    terms = query_terms(query)
    ensure_checkpoints(docs.sparkSession)
    within = r"[\p{L}\p{N}_]"
    low = docs.select(key, F.lower(text).alias("low"))
    counts = [F.regexp_count("low", F.lit(f"(?<!{within}){t}(?!{within})")).cast("bigint").alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = low.select(key, F.regexp_count("low", F.lit(f"{within}+")).cast("bigint").alias("dl"), *counts).checkpoint()
    used = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), *used)
    score, any_term = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        score = score + idf(F.col("n_docs"), F.col(f"df{i}")) * saturated(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))
        any_term = any_term | (F.col(f"tf{i}") > 0)
    return rows.where(any_term).crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))  # stats: one row


def concordance(turns: DataFrame, word: str, context: int = 10, text: str = "turn_text") -> DataFrame:
    """First match of a turn in its context: left, keyword, right (words by single spaces).

    The keyword spans as many words as the query has, from the one in which the match begins.
    """
    flat, span = F.trim(F.regexp_replace(text, r"\s+", " ")), max(1, len(word.split()))
    hits = turns.withColumn("__t", flat).withColumn("__at", F.locate(" ".join(word.lower().split()), F.lower("__t"))).where("__at > 0")
    before = F.size(F.split(F.expr("substr(__t, 1, __at - 1)"), " ")) - 1
    hits = hits.withColumn("__w", F.split("__t", " ")).withColumn("__i", before)
    left = F.array_join(F.slice("__w", F.greatest(F.col("__i") - context, F.lit(0)) + 1, F.least(F.col("__i"), F.lit(context))), " ")
    keyword = F.array_join(F.slice("__w", F.col("__i") + 1, F.lit(span)), " ")
    right = F.array_join(F.slice("__w", F.col("__i") + 1 + span, F.lit(context)), " ")
    return hits.select(*turns.columns, left.alias("left"), keyword.alias("keyword"), right.alias("right"))


def contexts(turns: DataFrame, word: str, reach: int = 25, text: str = "turn_text") -> DataFrame:
    """Every whole-word hit (edge punctuation ignored) with `reach` words on each side."""
    w = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    rows = turns.withColumn("__w", w).select(*turns.columns, "__w", F.posexplode("__w").alias("pos", "hit"))
    rows = rows.where(F.lower(F.regexp_replace("hit", r"^[\p{Punct}]+|[\p{Punct}]+$", "")) == word.lower())
    return rows.select(*turns.columns, "pos", F.array_join(F.slice("__w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + 1 + reach), " ").alias("context"))


def tone(contexts_: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "context") -> DataFrame:
    """keys, n_words (known ones), tone: the mean weight of a context's words in a lexicon (word, weight), which is the caller's."""
    words = contexts_.select(*keys, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}_']+")).alias("word"))
    met = words.join(lexicon, "word", "left").groupBy(*keys).agg(F.count("weight").alias("n_words"), F.avg("weight").alias("tone"))
    return met.select(*keys, "n_words", F.round(F.coalesce("tone", F.lit(0.0)), 6).alias("tone"))


def word_positions(turns: DataFrame, word: str, group: str = "episode_id", text: str = "turn_text") -> DataFrame:
    """Each occurrence (they may overlap) with its number in the episode and a time by linear interpolation in its turn.

    A turn is cut at the word's places found by a look-ahead, so the work is in proportion to its length.
    """
    if not word:
        raise ValueError("the word is empty")
    low, w = F.lower(text), word.lower()
    hits = turns.where(F.contains(low, F.lit(w))).select(group, "turn_count", "start_time", "end_time", F.length(text).alias("len"), low.startswith(w).alias("__first"), F.posexplode(F.split(low, f"(?={_quoted(w)})")).alias("__i", "__piece"))
    before = W.partitionBy(group, "turn_count", "start_time").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    rows = hits.repartition(group).withColumn("at", 1 + F.coalesce(F.sum(F.length("__piece")).over(before), F.lit(0))).where("__i > 0 or __first")  # each cut but the text's start is a place
    order = W.partitionBy(group).orderBy("start_time", "turn_count", "at")
    d = F.col("end_time") - F.col("start_time")
    return rows.select(group, "turn_count", F.row_number().over(order).cast("bigint").alias("occurrence"), F.when(d > 0, F.round(F.col("start_time") + d * (F.col("at") - 1) / F.col("len"), 4)).alias("estimate"), F.when(d > 0, F.round(F.least(F.lit(1.0), 10 / F.greatest(d, F.lit(1.0))), 4)).alias("confidence"))


def _quoted(word: str) -> str:
    """A pattern that matches the word itself."""
    return "".join(c if c.isalnum() or c.isspace() or not c.isascii() else "\\" + c for c in word)


#: Groups of a phrase that pair in one row; those of a phrase with more are dealt to blocks of about so many.
GROUPS = 256


def phrase_reuse(docs: DataFrame, text: str, n: int, owner: str, group: str) -> DataFrame:
    """Pairs of groups (a < b) of one owner that share phrases of n words, and how many. owner and group may have any names.

    Phrases are shuffled once, as packed digests in buckets; a bucket gives the sets of groups that share phrases, and how many they share.
    Groups pair within their set; those of a phrase that more than GROUPS have are dealt to blocks, which meet block by block, so a
    phrase of everyone is the work of many tasks. Groups are numbers until their pairs are counted.
    """
    named = docs.select(F.col(owner).alias("__o"), F.col(group).alias("__g"), F.col(text).alias("__text")).where("__g is not null")
    who = F.xxhash64(F.col("__o").isNull(), "__o", "__g").alias("__id")
    texts = named.select("__text", who, F.xxhash64("__o").alias("__s1"), F.xxhash64(F.lit(7), "__o").alias("__s2"))
    texts = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a file may be one row group
    sets = settled(shared_phrases(texts, n, GROUPS))
    pairs = _inside(sets.groupBy("members").agg(F.sum("n").alias("n")))
    if not (hot := sets.where("k > 1")).isEmpty():
        left = hot.select("g", "h", F.col("b").alias("__i"), "members", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("__j")).where("__i < __j")
        right = hot.select("g", "h", F.col("b").alias("__j"), F.col("members").alias("__others"))
        each = lambda x: F.transform("__others", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
        across = left.join(right, ["g", "h", "__j"]).select(F.lit(1).cast("bigint").alias("n"), F.explode(F.flatten(F.transform("members", each))).alias("__z"))
        pairs = pairs.unionByName(across)
    counted = pairs.groupBy("__z.a", "__z.b").agg(F.sum("n").alias("n_grams"))
    names = named.select("__o", "__g", who).distinct()
    met = counted.join(names.toDF("__o", "__x", "a"), "a").join(names.toDF("__p", "__y", "b"), "b")
    return met.select(F.col("__o").alias(owner), F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), "n_grams")


def _inside(sets: DataFrame) -> DataFrame:
    """Pairs within each row's sorted members."""
    later = lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return sets.select("n", F.explode(F.flatten(F.transform("members", later))).alias("__z"))


def cosine_pairs(weights: DataFrame, key: str, group: str) -> DataFrame:
    """Cosine similarity of documents of a group (a < b) that share a term; weights: key, group, term, weight of unit length.

    Pairs arise per shared term within a group, as products do in a sparse matrix; a group is a guest's documents, say, not a corpus.
    For a corpus see similar_pairs.
    """
    a = weights.select(group, "term", F.col(key).alias("a"), F.col("weight").alias("x"))
    b = weights.select(group, "term", F.col(key).alias("b"), F.col("weight").alias("y"))
    return a.join(b, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))


def similar_pairs(weights: DataFrame, key: str, least: float) -> DataFrame:
    """a < b, cosine of all pairs of documents whose cosine is at least `least` (above 0). weights: key, term, weight (not negative) of unit length.

    Terms are put in order of rarity. What of a document lies behind a term has a length; where that falls below `least`, the rest
    alone cannot reach it, so two documents of a pair share a term of both their prefixes, which the frequent terms are not in. The
    first term that they share bounds their product by the lengths from there on; what passes is verified by the whole vectors.
    """
    if not least > 0:
        raise ValueError("least must be above 0")
    rows = weights.where(F.col("weight") > 0).select(F.col(key).alias("__k"), F.col("term").alias("__t"), F.col("weight").alias("__w"))
    df = rows.groupBy("__t").agg(F.count("*").alias("__df")).where("__df > 1")  # a term of one document is in no pair, but counts in its length
    order = W.partitionBy("__k").orderBy(F.coalesce("__df", F.lit(1)), "__t").rowsBetween(0, W.unboundedFollowing)
    placed = rows.join(df, "__t", "left").withColumn("__rest", F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(order)))
    prefix = placed.where((F.col("__rest") >= least - 1e-9) & F.col("__df").isNotNull()).select("__k", "__t", "__rest")
    a, b = prefix.toDF("a", "__t", "__ra"), prefix.toDF("b", "__t", "__rb")
    met = a.join(b, "__t").where((F.col("a") < F.col("b")) & (F.col("__ra") * F.col("__rb") >= least - 1e-9)).select("a", "b").distinct()
    vector = rows.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("__t", "__w"))).alias("__v"))  # a document's own terms
    whole = met.join(vector.toDF("a", "__x"), "a").join(vector.toDF("b", "__y"), "b")
    dot = F.aggregate(F.map_entries("__x"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("__y", e["key"]), F.lit(0.0)))
    return whole.withColumn("__c", dot).where(F.col("__c") >= least).select("a", "b", F.round("__c", 6).alias("cosine"))


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 2) -> DataFrame:
    """key, term, weight with 1 + ln tf, smooth idf and unit length. Terms are lower-case runs of letters and numbers, not stemmed."""
    return term_weights(docs.select(key, text), key, term_list(F.make_valid_utf8(F.col(text))), min_df)  # as Arrow asks for
