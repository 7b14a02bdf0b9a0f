"""Queries of the library by name, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import taxonomy
from ..operators import catalog, frames, graphs, metrics, names, network, search, segments, stats, topics, windows
from ..operators.index import TextIndex
from ..operators.trigrams import TrigramIndex
from ..sources.readers import row_map, table
from ..sources.session import ensure_checkpoints, settled
from ..streaming import turns as stream
from . import stand_ins as S

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *ctes: str):
    """Registers a query under its function's name, with SQL over the given common tables."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return put


def measured(s, d):
    return metrics.turn_metrics(S.turns(s, d), X.token_count(F.col("turn_text"), S.TOKENS))


_TOKENS = ", ".join(f"'{t}'" for t in S.TOKENS)
MEASURED = f"""measured AS (SELECT *, CASE WHEN known THEN round(greatest(start_time - prev_end, 0.0), 4) END AS gap_from_prev, CASE WHEN known THEN round(greatest(prev_end - start_time, 0.0), 4) END AS overlap_with_prev FROM (
  SELECT *, prev_end IS NOT NULL AND start_time > 0 AS known FROM (
    SELECT *, last_value(CASE WHEN end_time > 0 THEN end_time END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY start_time, turn_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
      length(turn_text)::BIGINT AS char_count, CASE WHEN duration > 0 THEN round(word_count / duration, 4) ELSE 0 END AS words_per_second,
      len(list_filter(regexp_split_to_array(lower(turn_text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ({_TOKENS})))::BIGINT AS discourse_marker_count FROM turns)))"""


def _windows(size: int, overlap: int, partial: bool = False) -> str:
    step = size - overlap
    more = f"ceil((n - {size}) / {step}.0)" if partial else f"(n - {size}) // {step}"
    return f"""spread AS (SELECT *, CASE WHEN n <= {size} THEN 1 ELSE {more} + 1 END::BIGINT AS n_windows FROM (
  SELECT *, count(*) OVER (PARTITION BY episode_id) AS n, row_number() OVER (PARTITION BY episode_id ORDER BY start_time, turn_count) - 1 AS pos FROM turns)),
placed AS (SELECT s.*, w.window_index FROM spread s, (SELECT unnest(generate_series(0, 2000)) AS window_index) w WHERE w.window_index < n_windows AND pos >= w.window_index * {step} AND pos < w.window_index * {step} + {size})"""


_WINDOW = """SELECT episode_id, window_index, count(*) AS n_turns, min(pos) AS start_index, max(pos) + 1 AS end_index, min(start_time) AS start_time, max(end_time) AS end_time,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(flatten(list(p.speaker))) AS x)) AS n_speakers, count(*) FILTER (WHERE role = 'host') AS host_turns, count(*) FILTER (WHERE role = 'guest') AS guest_turns,
  string_agg(turn_text, ' ' ORDER BY pos) AS text, max(end_time) - min(start_time) AS duration, arg_max(end_time, pos) - min(start_time) AS duration_to_last_turn
FROM placed p GROUP BY episode_id, window_index"""
_WINDOW = _WINDOW.replace("(SELECT count(DISTINCT x) FROM (SELECT unnest(flatten(list(p.speaker))) AS x))", "len(list_distinct(flatten(list(speaker))))::BIGINT")


@query(_WINDOW, S.TURNS, _windows(4, 2))
def q_window_count(s, d):
    return windows.window_frame(S.turns(s, d), 4, 2)


@query(_WINDOW, S.TURNS, _windows(4, 2))
def q_window_count_ranged(s, d):
    """The same for episodes that may be too large for one task."""
    return windows.window_frame(S.turns(s, d), 4, 2, hot=True)


@query(_WINDOW, S.TURNS, _windows(3, 1, True))
def q_window_partial(s, d):
    return windows.window_frame(S.turns(s, d), 3, 1, partial=True)


@query(
    """SELECT s.episode_id, s.window_index, s.window_index * 30.0::DOUBLE AS window_start, least(s.window_index * 30.0::DOUBLE + 60, total) AS window_end,
  coalesce(sum(n), 0)::BIGINT AS n_turns, coalesce(sum(w), 0)::BIGINT AS words, round(coalesce(sum(w), 0) * 60 / 60.0::DOUBLE, 4) AS words_per_minute,
  CASE WHEN sum(w) > 0 THEN round(coalesce(max(w) FILTER (WHERE who IS NOT NULL), 0) / sum(w), 4) END AS top_share
FROM (SELECT episode_id, total, unnest(generate_series(0, greatest(1, floor((total - 60) / 30)::BIGINT + 1) - 1)) AS window_index FROM (SELECT episode_id, max(end_time) AS total FROM turns GROUP BY 1)) s
LEFT JOIN (SELECT t.episode_id, k.window_index, speaker[1] AS who, count(*) AS n, sum(word_count) AS w FROM turns t, (SELECT unnest(generate_series(0, 10000)) AS window_index) k
  WHERE start_time < end_time AND start_time < k.window_index * 30 + 60 AND end_time > k.window_index * 30 GROUP BY ALL) m ON m.episode_id = s.episode_id AND m.window_index = s.window_index
GROUP BY s.episode_id, s.window_index, s.total""",
    S.TURNS,
)
def q_window_by_time(s, d):
    return windows.time_window_frame(S.turns(s, d), 60.0, 30.0)


@query("SELECT episode_id, count(*) AS n_turns, CASE WHEN count(*) <= 4 THEN 1 ELSE (count(*) - 4) // 2 + 1 END::BIGINT AS n_windows, round(avg(end_time - start_time) * 4, 4) AS avg_window_duration FROM turns GROUP BY 1", S.TURNS)
def q_window_stats(s, d):
    return windows.window_statistics(S.turns(s, d), 4, 2)


@query("SELECT episode_id, window_index, role AS value, count(*) AS n FROM placed GROUP BY ALL", S.TURNS, _windows(4, 2))
def q_window_role_hist(s, d):
    return windows.window_histogram(S.turns(s, d), "role", 4, 2)


@query("SELECT episode_id, window_index, value, count(*) AS n FROM (SELECT episode_id, window_index, unnest(speaker) AS value FROM placed) GROUP BY ALL", S.TURNS, _windows(4, 2))
def q_window_speaker_hist(s, d):
    return windows.window_histogram(S.turns(s, d), "speaker", 4, 2)


@query("SELECT episode_id, window_index, turn_count, window_index > 0 AND pos < window_index * 2 + 2 AS is_overlap FROM placed", S.TURNS, _windows(4, 2))
def q_window_members(s, d):
    return windows.assign_windows(S.turns(s, d), 4, 2).select("episode_id", "window_index", "turn_count", "is_overlap")


@query("SELECT episode_id, turn_count, word_count, char_count, words_per_second, gap_from_prev, overlap_with_prev, discourse_marker_count FROM measured", S.TURNS, MEASURED)
def q_turn_metrics(s, d):
    return measured(s, d).select("episode_id", "turn_count", "word_count", "char_count", "words_per_second", "gap_from_prev", "overlap_with_prev", "discourse_marker_count")


_R = lambda a, b, k="1.0": f"CASE WHEN ({b}) <> 0 THEN round({k}::DOUBLE * ({a}) / ({b}), 4) ELSE 0 END"


@query(
    f"""SELECT episode_id, sum(word_count)::BIGINT AS total_word_count, count(*) AS total_turn_count, len(list_distinct(flatten(list(speaker))))::BIGINT AS unique_speaker_count,
  coalesce(round(avg(d), 4), 0) AS avg_turn_duration, coalesce(round(median(d), 4), 0) AS median_turn_duration, {_R("sum(word_count)", "coalesce(sum(d), 0)")} AS avg_words_per_second,
  count(*) FILTER (WHERE h) AS host_turn_count, count(*) FILTER (WHERE NOT h AND contains(lower(role), 'guest')) AS guest_turn_count, {_R("count(*) FILTER (WHERE h)", "count(*)")} AS host_turn_proportion,
  {_R("coalesce(sum(word_count) FILTER (WHERE h), 0)", "sum(word_count)")} AS host_word_proportion, coalesce(round(avg(gap_from_prev) FILTER (WHERE gap_from_prev > 0), 4), 0) AS avg_gap_duration,
  coalesce(round(sum(overlap_with_prev), 4), 0) AS total_overlap_duration, {_R("sum(discourse_marker_count)", "sum(word_count)", "1000.0")} AS discourse_marker_rate,
  {_R("coalesce(sum(word_count) FILTER (WHERE h), 0)", "coalesce(sum(d) FILTER (WHERE starts_with(lower(role), 'host')), 0)")} AS speaking_rate_host,
  coalesce(sum(word_count) FILTER (WHERE h), 0)::BIGINT AS host_word_count, coalesce(sum(word_count) FILTER (WHERE g), 0)::BIGINT AS guest_word_count, sum(discourse_marker_count)::BIGINT AS discourse_marker_count,
  {_R("coalesce(sum(word_count) FILTER (WHERE g), 0)", "coalesce(sum(d) FILTER (WHERE starts_with(lower(role), 'guest')), 0)")} AS speaking_rate_guest
FROM (SELECT *, contains(lower(role), 'host') AS h, NOT contains(lower(role), 'host') AND contains(lower(role), 'guest') AS g, CASE WHEN end_time > start_time THEN end_time - start_time END AS d FROM measured) GROUP BY episode_id""",
    S.TURNS,
    MEASURED,
)
def q_episode_metrics(s, d):
    return metrics.episode_metrics(measured(s, d))


@query("SELECT episode_id, count(*) AS n_turns, sum(word_count)::BIGINT AS words, round(avg(end_time - start_time), 4) AS avg_duration, round(avg(word_count), 4) AS avg_words FROM turns GROUP BY 1", S.TURNS)
def q_turn_statistics(s, d):
    return metrics.turn_statistics(S.turns(s, d))


@query("SELECT episode_id, coalesce(nullif(role, ''), 'unknown') AS role, count(*) AS n FROM turns GROUP BY ALL", S.TURNS)
def q_role_histogram(s, d):
    return metrics.role_histogram(S.turns(s, d))


@query(
    f"""SELECT episode_id, array_to_string(list_sort(list_distinct(flatten(list(speaker)))), ',') AS labels, round(avg(d), 4) AS avg_turn_duration, round(count(*) FILTER (WHERE len(speaker) > 1) / count(*), 4) AS overlap_prop_turn_count,
  {_R("coalesce(sum(d) FILTER (WHERE len(speaker) > 1), 0)", "sum(d)")} AS overlap_prop_duration FROM (SELECT *, end_time - start_time AS d FROM turns) GROUP BY 1""",
    S.TURNS,
)
def q_episode_turn_stats(s, d):
    return metrics.episode_turn_stats(S.turns(s, d))


@query("SELECT episode_id, turn_count FROM turns WHERE word_count >= 20 AND role = 'host' AND list_contains(speaker, 'crosstalk')", S.TURNS)
def q_turn_filters(s, d):
    return frames.by_speaker(frames.by_min_words(S.turns(s, d), 20).where("role = 'host'"), "crosstalk").select("episode_id", "turn_count")


@query("SELECT episode_id, turn_count FROM turns WHERE start_time >= 10 AND end_time <= 90", S.TURNS)
def q_time_range_strict(s, d):
    return frames.in_time_range(S.turns(s, d), 10, 90).select("episode_id", "turn_count")


@query("SELECT episode_id, turn_count, greatest(start_time, 10.0) AS trimmed_start, least(end_time, 90.0) AS trimmed_end, start_time < 10 OR end_time > 90 AS was_trimmed FROM turns WHERE start_time < 90 AND end_time > 10", S.TURNS)
def q_time_range_trim(s, d):
    return frames.in_time_range(S.turns(s, d), 10, 90, "partial").select("episode_id", "turn_count", "trimmed_start", "trimmed_end", "was_trimmed")


@query("SELECT episode_id, turn_count, start_time AS trimmed_start, end_time AS trimmed_end, false AS was_trimmed FROM turns WHERE start_time < 90 AND end_time > 10", S.TURNS)
def q_time_range_full(s, d):
    return frames.in_time_range(S.turns(s, d), 10, 90, "full").select("episode_id", "turn_count", "trimmed_start", "trimmed_end", "was_trimmed")


@query("SELECT episode_id, turn_count, len(speaker)::INT AS n_speakers, len(speaker) > 1 AS is_overlapping, speaker[1] AS primary_speaker, role = 'host' AS is_host, role = 'guest' AS is_guest, role <> 'NO_INFERRED_ROLE' AS has_inferred_role FROM turns", S.TURNS)
def q_speaker_columns(s, d):
    return frames.add_speaker_columns(S.turns(s, d)).select("episode_id", "turn_count", "n_speakers", "is_overlapping", "primary_speaker", "is_host", "is_guest", "has_inferred_role")


@query("SELECT episode_id, turn_count FROM turns WHERE trim(turn_text) <> '' AND end_time > start_time", S.TURNS)
def q_strict_turns(s, d):
    return frames.strict_turns(S.turns(s, d)).select("episode_id", "turn_count")


@query("SELECT a, b, count(*) AS n FROM (SELECT speaker[1] AS a, lead(speaker[1]) OVER (PARTITION BY episode_id ORDER BY start_time, turn_count) AS b FROM turns) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL", S.TURNS)
def q_transitions(s, d):
    return metrics.transitions(S.turns(s, d))


@query("SELECT *, round(seconds / sum(seconds) OVER (PARTITION BY episode_id), 4) AS share FROM (SELECT episode_id, who, count(*) AS turns, sum(d) AS seconds FROM (SELECT episode_id, unnest(speaker) AS who, end_time - start_time AS d FROM turns) GROUP BY ALL)", S.TURNS)
def q_dominance(s, d):
    return metrics.dominance(S.turns(s, d))


@query("SELECT episode_id, round(count(*) FILTER (WHERE word_count > 50) / count(*), 4) AS long_share, round(count(*) FILTER (WHERE word_count <= 10) / count(*), 4) AS short_share, round(avg(word_count) FILTER (WHERE role = 'host'), 4) AS host_words, round(avg(word_count) FILTER (WHERE role = 'guest'), 4) AS guest_words FROM turns GROUP BY 1", S.TURNS)
def q_profile(s, d):
    return metrics.discourse_profile(S.turns(s, d))


@query("SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l USING (doc_id)")
def q_join_metrics_left(s, d):
    return frames.left_join_side(table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "labels"), ["doc_id"], ["quality", "toxic"])


_FIRST = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT o.o_orderkey AS l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity FROM orders o LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_FIRST)}) = 1) l ON o.o_orderkey = l.l_orderkey")
def q_join_dedup_left(s, d):
    one = frames.keep_first(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], _FIRST)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(one, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_has_turns_semi(s, d):
    return frames.pin(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_no_turns_anti(s, d):
    return frames.without(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'thea') ORDER BY doc_id LIMIT 50 OFFSET 5")
def q_search_exact(s, d):
    return search.page(search.scan(table(s, d, "documents"), "thea", "exact", "text"), ["doc_id"], 50, 5).select("doc_id", "score")


@query(r"SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, 'the[a-z]{3}\b|[A-Z]n[a-z]+ing')")
def q_search_regex(s, d):
    return search.scan(table(s, d, "documents"), r"the[a-z]{3}\b|[A-Z]n[a-z]+ing", "regex", "text").select("doc_id", "score")


_TF = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in ("and", "the"))


@query(f"SELECT doc_id, ({_TF})::DOUBLE AS score FROM documents WHERE contains(lower(text), 'and') AND contains(lower(text), 'the')")
def q_search_tf(s, d):
    return search.scan(table(s, d, "documents"), "and the", "fts", "text").select("doc_id", "score")


@query(f"SELECT source, count(*) AS n_hits, max(({_TF})::DOUBLE) AS best_score FROM documents WHERE contains(lower(text), 'and') AND contains(lower(text), 'the') GROUP BY 1")
def q_search_hits(s, d):
    return search.episode_hits(search.scan(table(s, d, "documents"), "and the", "fts", "text"), "source")


_INDEXES: dict[tuple, str] = {}


def _written(s, kind, d, write, *options) -> str:
    """Folder of an index, written once a session to the folder that all executors share; known by the values of its options."""
    at = (s.sparkContext.applicationId, kind, d, *options)
    if at not in _INDEXES:
        ensure_checkpoints(s)
        path = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{len(_INDEXES)}"
        write(path)
        _INDEXES[at] = path
    return _INDEXES[at]


def text_index(s, d, stemmed=False, stop_words=()) -> TextIndex:
    """Of the documents."""
    return TextIndex.open(s, _written(s, "text-index", d, lambda path: TextIndex.write(table(s, d, "documents"), ["doc_id"], "text", path, stemmed, stop_words), stemmed, stop_words))


def trigram_index(s, d) -> TrigramIndex:
    """Of the documents."""
    return TrigramIndex.open(s, _written(s, "trigrams", d, lambda path: TrigramIndex.write(table(s, d, "documents"), ["doc_id"], "text", path)))


POSTINGS = r"""terms AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ts FROM documents),
posts AS (SELECT term, doc_id, count(*) AS tf, first(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM terms) GROUP BY term, doc_id)"""


_BM25 = """SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM posts JOIN (SELECT term, count(*) AS df FROM posts WHERE term IN ('the', 'und') GROUP BY 1) USING (term), (SELECT count(*)::DOUBLE AS n FROM documents), (SELECT avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM posts)) GROUP BY doc_id"""


@query(_BM25, POSTINGS)
def q_search_bm25(s, d):
    """Over a written index; its first use in a session writes it."""
    return text_index(s, d).scores("the und")


@query(_BM25 + " ORDER BY score DESC, doc_id LIMIT 25", POSTINGS)
def q_search_bm25_best(s, d):
    """The best over a written index: blocks that cannot reach them are not read."""
    return text_index(s, d).best("the und", 25)


@query(_BM25.replace(" GROUP BY doc_id", " WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') GROUP BY doc_id") + " ORDER BY score DESC, doc_id LIMIT 25", POSTINGS)
def q_search_bm25_filtered(s, d):
    """The best of some documents, scored by the statistics of all."""
    return text_index(s, d).best("the und", 25, table(s, d, "documents").where("lang = 'de'"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'heat in')")
def q_search_exact_indexed(s, d):
    """A substring by the trigram index, then verified."""
    return search.scan(trigram_index(s, d).candidates(table(s, d, "documents"), "Heat in", "exact"), "Heat in", "exact", "text").select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(thingre|onen[a-z]and)\b.{0,40}(stin|heat)+')")
def q_search_regex_indexed(s, d):
    """An expression by the trigram index, then verified."""
    pattern = r"(thingre|onen[a-z]and)\b.{0,40}(stin|heat)+"
    return search.scan(trigram_index(s, d).candidates(table(s, d, "documents"), pattern, "regex"), pattern, "regex", "text").select("doc_id")


@query(_BM25, POSTINGS)
def q_search_bm25_scan(s, d):
    """By a scan of the documents."""
    return search.bm25(table(s, d, "documents"), "doc_id", "text", "the und")



@query(
    """SELECT doc_id, round(sum(weight * weight), 6) AS norm, round(max(weight), 6) AS top_weight, count(*) AS n_terms FROM (
  SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM posts JOIN (SELECT term, count(*) AS df FROM posts GROUP BY 1 HAVING count(*) >= 2) USING (term), (SELECT count(*)::DOUBLE AS n FROM documents))) GROUP BY doc_id""",
    POSTINGS,
)
def q_tfidf(s, d):
    return search.tfidf(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"), F.round(F.max("weight"), 6).alias("top_weight"), F.count("*").alias("n_terms"))


_KWIC = r"""hits AS (SELECT *, string_split(t, ' ') AS w, len(string_split(substr(t, 1, place - 1), ' ')) - 1 AS i FROM (SELECT *, instr(lower(t), 'the') AS place FROM (SELECT episode_id, turn_count, trim(regexp_replace(turn_text, '\s+', ' ', 'g')) AS t FROM turns)) WHERE place > 0)"""


@query("SELECT episode_id, turn_count, array_to_string(w[greatest(i - 10, 0) + 1:i], ' ') AS \"left\", w[i + 1] AS keyword, array_to_string(w[i + 2:i + 11], ' ') AS \"right\" FROM hits", S.TURNS, _KWIC)
def q_kwic(s, d):
    return search.concordance(S.turns(s, d).select("episode_id", "turn_count", "turn_text"), "the").drop("turn_text")


@query(
    r"""SELECT episode_id, turn_count, (p - 1)::INT AS pos, array_to_string(w[greatest(p - 25, 1):p + 25], ' ') AS context FROM (SELECT episode_id, turn_count, w, unnest(generate_series(1, len(w))) AS p FROM (
  SELECT episode_id, turn_count, string_split(trim(regexp_replace(turn_text, '\s+', ' ', 'g')), ' ') AS w FROM turns)) WHERE lower(regexp_replace(w[p], '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) = 'the'""",
    S.TURNS,
)
def q_context(s, d):
    return search.contexts(S.turns(s, d).select("episode_id", "turn_count", "turn_text"), "the").drop("turn_text")


@query(
    """SELECT episode_id, turn_count, row_number() OVER (PARTITION BY episode_id ORDER BY start_time, turn_count, place) AS occurrence, round(start_time + duration * (place - 1) / n, 4) AS estimate, round(least(1.0::DOUBLE, 10 / greatest(duration, 1.0::DOUBLE)), 4) AS confidence
FROM (SELECT *, unnest(list_filter(generate_series(1, n), lambda i: substr(lower(turn_text), i, 3) = 'the')) AS place FROM (SELECT *, length(turn_text) AS n FROM turns)) WHERE duration > 0""",
    S.TURNS,
)
def q_word_position(s, d):
    return search.word_positions(S.turns(s, d), "the").where("estimate is not null")


_GRAMS = """words AS (SELECT lang AS owner, source, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
grams AS (SELECT DISTINCT owner, source, array_to_string(w[i:i + 6], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 6)) AS i FROM words))"""


@query("SELECT a.owner AS lang, a.source AS a, b.source AS b, count(*) AS n_grams FROM grams a JOIN grams b USING (owner, gram) WHERE a.source < b.source GROUP BY ALL", _GRAMS)
def q_ngram_reuse(s, d):
    return search.phrase_reuse(table(s, d, "documents").where("lang is not null"), "text", 7, "lang", "source")  # SQL joins no null owner


@query("SELECT lower(trim(c_name)) AS name_normalized, c_nationkey, min(c_name) AS name_original FROM customer WHERE trim(c_name) <> '' GROUP BY ALL")
def q_name_index(s, d):
    return names.name_index(table(s, d, "customer").select("c_nationkey", F.array("c_name").alias("n")), "n", ["c_nationkey"])


@query("SELECT lower(trim(c_name)) AS name_normalized, c_nationkey, min(c_name) AS name_original FROM customer WHERE contains(lower(trim(c_name)), '12') GROUP BY ALL")
def q_name_lookup(s, d):
    return names.lookup(names.name_index(table(s, d, "customer").select("c_nationkey", F.array("c_name").alias("n")), "n", ["c_nationkey"]), " 12 ")


@query("SELECT a.podcast_id AS a, b.podcast_id AS b, count(*) AS weight FROM (SELECT DISTINCT * FROM appearances) a JOIN (SELECT DISTINCT * FROM appearances) b USING (guest) WHERE a.podcast_id < b.podcast_id GROUP BY ALL", S.APPEARANCES)
def q_shared_guest_pairs(s, d):
    return network.shared_pairs(S.appearances(s, d), "guest", "podcast_id")


_PAIRS = "pairs AS (SELECT a.podcast_id AS a, b.podcast_id AS b, count(*) AS weight FROM (SELECT DISTINCT * FROM appearances) a JOIN (SELECT DISTINCT * FROM appearances) b USING (guest) WHERE a.podcast_id < b.podcast_id GROUP BY ALL)"


@query("SELECT node, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree FROM (SELECT a AS node, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) GROUP BY 1", S.APPEARANCES, _PAIRS)
def q_degree(s, d):
    return network.degrees(network.shared_pairs(S.appearances(s, d), "guest", "podcast_id"))


@query("SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.episode_id, x.turn_count, x.v AS a, y.v AS b FROM (SELECT episode_id, turn_count, unnest(speaker) AS v FROM turns) x JOIN (SELECT episode_id, turn_count, unnest(speaker) AS v FROM turns) y USING (episode_id, turn_count) WHERE x.v < y.v) GROUP BY ALL", S.TURNS)
def q_comention(s, d):
    return network.comentions(S.turns(s, d), "speaker")


@query(None)
def q_components(s, d):
    """Components of the graph of guests and shows, over all appearances."""
    e = S.appearances(s, d).select(F.col("guest").alias("a"), (F.lit(100000000) + F.col("podcast_id")).alias("b"))
    return network.components(e)


@query("SELECT count(DISTINCT podcast_id) AS n_shows, count(*) AS n_episodes, round(sum(duration_seconds) / 3600, 4) AS hours, round(avg(duration_seconds) / 60, 4) AS mean_minutes FROM episodes", S.EPISODES)
def q_corpus_stats(s, d):
    return catalog.corpus_statistics(S.episodes(s, d))


@query("SELECT trim(c) AS category, count(*) AS n FROM (SELECT unnest([p_brand, p_type]) AS c FROM part) WHERE trim(c) <> '' GROUP BY 1")
def q_category_dist(s, d):
    return catalog.category_distribution(table(s, d, "part"), ["p_brand", "p_type"])


@query("SELECT CASE WHEN r <= 7 THEN category ELSE 'Other' END AS category, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS r FROM (SELECT trim(p_type) AS category, count(*) AS n FROM part GROUP BY 1)) GROUP BY 1")
def q_fold_other(s, d):
    return catalog.fold_tail(catalog.category_distribution(table(s, d, "part"), ["p_type"]), "category", "n")


@query(
    """SELECT e.podcast_id, count(*) AS n_episodes, sum(duration_seconds) AS total_duration, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, min(category) AS catalog_primary_category,
  arg_min(episode_id, (duration_seconds, episode_id)) AS shortest, arg_max(episode_id, (duration_seconds, -episode_id)) AS longest, first(modal_category) AS modal_category
FROM episodes e JOIN (SELECT podcast_id, arg_max(category, (n, -f)) AS modal_category FROM (SELECT podcast_id, category, count(*) AS n, min(episode_id) AS f FROM episodes GROUP BY ALL) GROUP BY 1) m USING (podcast_id) GROUP BY e.podcast_id""",
    S.EPISODES,
)
def q_show_rollup(s, d):
    return catalog.show_rollup(S.episodes(s, d))


@query("SELECT podcast_id, round(min(m), 4) AS min_minutes, round(max(m), 4) AS max_minutes, round(median(m), 4) AS median_minutes, round(avg(m), 4) AS mean_minutes, count(*) FILTER (WHERE duration_seconds > 1800) AS n_long, count(*) FILTER (WHERE duration_seconds < 600) AS n_short FROM (SELECT *, duration_seconds / 60 AS m FROM episodes) GROUP BY 1", S.EPISODES)
def q_show_stats(s, d):
    return catalog.show_statistics(S.episodes(s, d))


@query("SELECT podcast_id, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(podcast_id), podcast_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT podcast_id, count(*) AS n FROM episodes GROUP BY 1)) WHERE b < 200", S.EPISODES)
def q_sample_shows(s, d):
    return catalog.sample_shows(S.episodes(s, d), 200, F.md5("podcast_id"))


@query("SELECT episode_id, duration_seconds FROM episodes WHERE duration_seconds BETWEEN 500 AND 4000 AND num_main_speakers >= 1 AND num_main_speakers <= 2 AND lower(language) = 'en' AND podcast_id IN (SELECT podcast_id FROM episodes WHERE contains(lower(category), 'd')) ORDER BY episode_id LIMIT 40", S.EPISODES)
def q_search_episodes(s, d):
    e = S.episodes(s, d)
    return catalog.search_episodes(e, categories=e.select("podcast_id", "category"), limit=40, min_duration=500, max_duration=4000, min_speakers=1, max_speakers=2, language="EN", category="D").select("episode_id", "duration_seconds")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 150000 AND o_custkey >= 10 ORDER BY o_orderkey LIMIT 10000")
def q_filter_by_metrics(s, d):
    return catalog.filter_by_metrics(table(s, d, "orders"), order="o_orderkey", o_totalprice=(1000, 150000), o_custkey=(10, None)).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey AS podcast_id, s_name AS pod_title FROM supplier WHERE contains(lower(s_name), '7') ORDER BY lower(s_name) = '7' DESC, s_suppkey LIMIT 1")
def q_title_lookup(s, d):
    return catalog.find_show(S.shows(s, d), "7")


@query("SELECT w.user_id, word_id, segment_id, label FROM words w JOIN segments s ON w.user_id = s.user_id AND s_start < w_end AND s_end > w_start", S.INTERVALS)
def q_interval_label(s, d):
    w, g = S.intervals(s, d)
    return segments.interval_join(w, g, "user_id", 7200.0).select("user_id", "word_id", "segment_id", "label")


_KEYED = "keyed AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS k, epoch(ts) AS t, value FROM events)"
_ISLANDS = """carried AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM keyed),
runs AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM (SELECT *, CASE WHEN c <> lag(c) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM carried))"""


def _keyed(s, d):
    t = table(s, d, "events")
    return t.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("start"), "value")


@query("SELECT user_id, event_id, c AS key, run FROM runs", _KEYED, _ISLANDS)
def q_islands(s, d):
    return segments.islands(_keyed(s, d), "user_id", ["event_id"], "key").select("user_id", "event_id", "key", "run")


@query("SELECT user_id, event_id, c AS key, run FROM runs", _KEYED, _ISLANDS)
def q_islands_ranged(s, d):
    """The same for groups that may be too large for one task."""
    return segments.islands(_keyed(s, d), "user_id", ["event_id"], "key", hot=True).select("user_id", "event_id", "key", "run")


@query("SELECT user_id, run AS turn_count, c AS key, count(*) AS n_words, floor(min(t)) AS start_time, floor(max(t)) + 1 AS end_time, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS turn_text, round(avg(value), 8) AS value_mean, round(stddev_pop(value), 8) AS value_stdev FROM runs GROUP BY ALL", _KEYED, _ISLANDS)
def q_turn_build(s, d):
    rows = _keyed(s, d).withColumn("end", F.col("start") + 1).withColumn("word", F.col("event_id").cast("string"))
    out = segments.build_turns(rows, "user_id", ["event_id"], "key", ("value",))
    return out.withColumns({c: F.round(c, 8) for c in ("value_mean", "value_stdev")})


@query("SELECT episode_id, turn_count, CASE WHEN list_contains(speaker, 'user') THEN 'Ann' WHEN list_contains(speaker, 'crosstalk') THEN 'Bo' ELSE 'NO_INFERRED_SPEAKER' END AS speaker_name, CASE WHEN list_contains(speaker, 'user') THEN 'guest' WHEN list_contains(speaker, 'crosstalk') THEN 'host' ELSE 'NO_INFERRED_ROLE' END AS role FROM turns", S.TURNS)
def q_name_restore(s, d):
    t = S.turns(s, d)
    labels = F.explode(F.array(F.struct(F.lit("user").alias("label"), F.lit("Ann").alias("name"), F.lit("guest").alias("label_role")), F.struct(F.lit("crosstalk").alias("label"), F.lit("Bo").alias("name"), F.lit("host").alias("label_role"))))
    known = t.select("episode_id").distinct().select("episode_id", labels.alias("x")).select("episode_id", "x.*")
    return names.restore_names(t, known).select("episode_id", "turn_count", "speaker_name", "role")


@query("SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 20 WINDOW w AS (PARTITION BY user_id)")
def q_zscore(s, d):
    return stats.z_scores(table(s, d, "events"), "user_id", "value", 20).select("event_id", F.round("z", 6).alias("z"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(count(*) FILTER (WHERE value > 50) / count(*), 4) AS rate FROM events GROUP BY 1")
def q_daily_rate(s, d):
    return stats.rate_per_day(table(s, d, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("value") > 50)


@query("SELECT user_id, round(b, 4) AS mean_before, round(a, 4) AS mean_after, round(a - b, 4) AS delta FROM (SELECT user_id, avg(value) FILTER (WHERE day(ts) <= 15) AS b, avg(value) FILTER (WHERE day(ts) > 15) AS a FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def q_paired_delta(s, d):
    return stats.paired_delta(table(s, d, "events"), "user_id", F.day("ts") > 15, "value")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(stddev_samp(l_discount), 6) AS sd, round(quantile_cont(l_quantity, 0.25), 4) AS q25 FROM lineitem GROUP BY 1")
def q_corr(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"), F.round(F.percentile("l_quantity", F.lit(0.25)), 4).alias("q25"))


@query(
    """SELECT l_returnflag, round((hxx * d - 2 * hxy * b + hyy * a) / nullif(a * d - b * b, 0), 4) AS pillai FROM (SELECT *, hxx + exx AS a, hyy + eyy AS d, hxy + exy AS b FROM (
  SELECT l_returnflag, sum(n * mx * mx) - sum(n * mx) ** 2 / sum(n) AS hxx, sum(n * my * my) - sum(n * my) ** 2 / sum(n) AS hyy, sum(n * mx * my) - sum(n * mx) * sum(n * my) / sum(n) AS hxy, sum(n * vx) AS exx, sum(n * vy) AS eyy, sum(n * c) AS exy
  FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, var_pop(l_extendedprice) AS vy, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2))"""
)
def q_pillai(s, d):
    return stats.pillai(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")


@query("SELECT (sum(r) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'click') * (count(*) FILTER (WHERE event_type = 'click') + 1) / 2.0)::DOUBLE AS u, count(*) FILTER (WHERE event_type = 'click') AS n1, count(*) FILTER (WHERE event_type <> 'click') AS n2 FROM (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events)")
def q_mann_whitney(s, d):
    rows = table(s, d, "events").withColumn("click", F.col("event_type") == "click")
    return stats.mann_whitney(rows, "click", "value").withColumn("u", F.col("u").cast("double"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def q_dates_day(s, d):
    text = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return table(s, d, "events").select("event_id", F.date_format(X.millis_timestamp(text), "yyyy-MM-dd").alias("day"))


@query("SELECT page_id, substr(md5(url), 1, 12) AS show_id, substr(md5(url), 1, 16) AS episode_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_replace(url, '[^A-Za-z0-9.]', '', 'g') AS url_key FROM pages")
def q_ids_hosts(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", X.show_id(u).alias("show_id"), X.episode_id(u).alias("episode_id"), X.host_name(u).alias("host"), X.url_key(u).alias("url_key"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def q_union_align(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("parent"))
    return frames.aligned_union([n, table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("extra"))], n)


@query("SELECT DISTINCT gram FROM grams WHERE owner = 'en' AND source = 'src0' INTERSECT SELECT DISTINCT gram FROM grams WHERE owner = 'en' AND source <> 'src0'", _GRAMS)
def q_intersect_grams(s, d):
    t = table(s, d, "documents").where("lang = 'en'")
    g = lambda x: x.select(F.explode(X.ngrams(F.col("text"), 7)).alias("gram"))
    return g(t.where("source = 'src0'")).intersect(g(t.where("source <> 'src0'")))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def q_except_used(s, d):
    return table(s, d, "part").select("p_partkey").subtract(table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@query("SELECT 'documents' AS tree, source AS podcast_id, count(*) AS num_rows FROM documents GROUP BY 2 UNION ALL SELECT 'labels', source, count(*) FROM labels JOIN documents USING (doc_id) GROUP BY 2")
def q_row_map(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("podcast_id"))
    return row_map({"documents": docs, "labels": table(s, d, "labels").join(docs, "doc_id")})


@query("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([b, b - INTERVAL 3 HOUR]) AS w, event_type, value FROM (SELECT *, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM events)) GROUP BY ALL")
def q_hist_window(s, d):
    return stream.windowed_counts(table(s, d, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS x FROM events)) GROUP BY user_id, k")
def q_session(s, d):
    return stream.sessions(table(s, d, "events")).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT p_partkey, p_size = 1 AS is_solo, p_size >= 2 AS is_interview, p_size >= 3 AS is_panel, p_retailprice > 1800 AS is_long, p_retailprice < 600 AS is_short FROM part")
def q_episode_kinds(s, d):
    t = table(s, d, "part")
    return t.select("p_partkey", *[c.alias(k) for k, c in X.episode_kind(F.lit(1), F.col("p_size") - 1, F.col("p_retailprice")).items()])


_SUBS = "subs(sub, main, i) AS (VALUES " + ", ".join(f"('{s}', '{m}', {i})" for i, (s, m) in enumerate(taxonomy.MAIN_OF.items())) + ")"


@query(f"SELECT p_partkey, sub AS category, main AS main_category FROM part JOIN subs ON p_partkey % {len(taxonomy.MAIN_OF)} = i", _SUBS)
def q_main_category(s, d):
    sub = F.element_at(F.lit(list(taxonomy.MAIN_OF)), (F.col("p_partkey") % len(taxonomy.MAIN_OF) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", sub.alias("category")).withColumn("main_category", taxonomy.main_category(F.col("category")))


_LANGUAGES = "names(code, name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in taxonomy.LANGUAGES.items()) + ")"


@query("SELECT doc_id, lang, name AS language_name FROM documents LEFT JOIN names ON lang = code", _LANGUAGES)
def q_language_name(s, d):
    return table(s, d, "documents").select("doc_id", "lang", taxonomy.language_name(F.col("lang")).alias("language_name"))


def _core(s, d):
    pairs = settled(network.shared_pairs(S.appearances(s, d), "guest", "podcast_id"))
    strong = pairs.agg(F.avg("weight") + F.stddev_samp("weight")).scalar()  # pairs that share more than most
    return settled(network.core(network.heavy(pairs, strong)))


@query(None)
def q_betweenness(s, d):
    """Exact: from all nodes, on tables where the core is too large for a task."""
    edges = _core(s, d)
    if edges.count() <= network.MAX_EDGES:
        return network.betweenness(edges)
    return graphs.sampled_betweenness(edges, edges.select(F.explode(F.array("a", "b"))).distinct().count())


@query(None)
def q_communities(s, d):
    """Greedy on the driver; by local moves where the core is too large for that. Communities count from 0, largest first."""
    edges = _core(s, d)
    if edges.count() <= network.MAX_EDGES:
        return network.communities(edges)
    of = graphs.local_communities(edges)
    least = of.groupBy("community").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.orderBy(F.desc("n"), "community")) - 1  # a row per community
    return of.join(least.select(F.col("community").alias("c"), place.alias("place")), F.col("community") == F.col("c")).select("node", F.col("place").alias("community"))


@query(None)
def q_betweenness_sampled(s, d):
    """Of the whole network of shows, from 64 pivots."""
    return graphs.sampled_betweenness(network.shared_pairs(S.appearances(s, d), "guest", "podcast_id"), 64, simple=True)


@query(None)
def q_communities_local(s, d):
    """Of the whole network of shows, by local moves."""
    return graphs.local_communities(network.shared_pairs(S.appearances(s, d), "guest", "podcast_id"), simple=True)


@query(None)
def q_topics(s, d):
    rows = topics.window_terms(S.turns(s, d), 4, 1, 20, 10)
    return topics.main_topic(topics.fit_topics(rows, k=5, iterations=10)[0])
