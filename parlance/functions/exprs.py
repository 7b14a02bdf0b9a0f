"""Column expressions over turns, episodes and shows. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data: sentinels for turns without an inferred speaker or role.
NO_SPEAKER, NO_ROLE, UNKNOWN_SPEAKER = "NO_INFERRED_SPEAKER", "NO_INFERRED_ROLE", "SPEAKER_UNKNOWN"
# Discourse markers.
MARKERS = ("um", "uh", "uh huh", "mm hmm", "like", "you know", "i mean", "so", "well", "right", "okay", "oh")


def word_count(text: Column) -> Column:
    """Whitespace-separated words, with Unicode white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def space_count_words(text: Column) -> Column:
    """Spaces plus one: the count of the search table, which differs from word_count on runs of spaces."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1


def marker_count(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?iU)\b({'|'.join(markers)})\b")), F.lit(0))


def token_count(text: Column, tokens: tuple[str, ...]) -> Column:
    """How many tokens (between characters other than letters and numbers) are one of the given lower-case ones."""
    return F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.isin(*tokens)))


def words_per_second(words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(words / seconds, 4)).otherwise(F.lit(0.0))


def primary_speaker(speaker: Column) -> Column:
    return F.try_element_at(speaker, F.lit(1))


def n_speakers(speaker: Column) -> Column:
    return F.coalesce(F.when(speaker.isNotNull(), F.size(speaker)), F.lit(0))


def is_placeholder(name: Column) -> Column:
    return name.isNull() | name.isin("", NO_SPEAKER, NO_ROLE, UNKNOWN_SPEAKER) | name.rlike(r"(?i)^SPEAKER_\d+$")


def normalized_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def contains_time(start: Column, end: Column, t: Column) -> Column:
    return (start <= t) & (t <= end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (e1 > s2)


def millis_timestamp(text: Column) -> Column:
    """Milliseconds since 1970 as text to a timestamp; null where it does not parse."""
    return F.timestamp_millis(text.try_cast("bigint"))


def host_name(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def show_id(rss_url: Column) -> Column:
    return F.substring(F.md5(rss_url), 1, 12)


def episode_id(mp3_url: Column) -> Column:
    return F.substring(F.md5(mp3_url), 1, 16)


def url_key(url: Column) -> Column:
    return F.regexp_replace(url, "[^A-Za-z0-9.]", "")


def safe_list(text: Column) -> Column:
    """'' and sentinels to an empty list, a JSON list to its items, any other text to a list of itself."""
    empty = F.array().cast("array<string>")
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull() | text.isin("", "SPEAKER_DATA_UNAVAILABLE", "NO_HOST_PREDICTED", "NO_GUEST_PREDICTED"), empty).when(text.startswith("["), F.coalesce(parsed, empty)).otherwise(F.array(text))


def label_names(json: Column) -> Column:
    """Names in a {name: label} text; null where it is no JSON object."""
    return F.json_object_keys(json)


def squashed_entity(text: Column) -> Column:
    """White space to single spaces, edge punctuation cut, a leading 'the' dropped, lower case."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")
    return F.regexp_replace(F.lower(flat), "^the ", "")


def episode_kind(n_hosts: Column, n_guests: Column, seconds: Column) -> dict[str, Column]:
    """Flags that may overlap: an interview of three people is a panel too."""
    return {
        "is_solo": (n_hosts == 1) & (n_guests == 0),
        "is_interview": (n_hosts >= 1) & (n_guests >= 1),
        "is_panel": n_hosts + n_guests > 2,
        "is_long": seconds > 1800,
        "is_short": seconds < 600,
    }


def vowel_index(phones: Column) -> Column:
    """0-based place of the vowel with primary stress, else secondary stress, else the first vowel; null if none."""
    at = lambda d: F.nullif(F.array_position(F.transform(phones, lambda p: F.right(p, F.lit(1))), F.lit(d)), F.lit(0))
    return F.coalesce(at("1"), at("2"), at("0")) - 1


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of [a-z']+ words, joined by spaces."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    grams = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")))[0]
    return F.array_distinct(grams)


def category_list(*columns: Column) -> Column:
    """The categories that are not null, in order."""
    return F.array_compact(F.array(*columns))


def safe_text(value: Column, default: str = "") -> Column:
    """Text without surrounding white space; null becomes the default."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(default))


def safe_number(value: Column, kind: str = "double") -> Column:
    """A number from anything, 0 where it is none."""
    return F.coalesce(value.cast("string").try_cast("double").cast(kind), F.lit(0).cast(kind))


def json_map(text: Column) -> Column:
    """A {name: label} text as a map; null where it is no JSON object."""
    return F.from_json(text, "map<string,string>")


def as_list(value: Column, is_list: bool) -> Column:
    """A list from a list, a scalar (of itself) or null (empty)."""
    if is_list:
        return F.coalesce(value, F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def feature_map(*features: str) -> Column:
    """The acoustic features that are not null, by name."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def lexical_set(word: Column, sets: dict[str, tuple[str, ...]]) -> Column:
    """The name of the set that holds the word, case and white space apart; null for others. The sets are the caller's."""
    key, out = F.lower(F.trim(word)), F.lit(None).cast("string")
    for name, words in sets.items():
        out = F.when(key.isin(*words), F.lit(name)).otherwise(out)
    return out


def hash_shard(key: Column, shards: int = 4096) -> Column:
    """A stable number below `shards`."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def quality_score(overlap_time: Column, overlap_turns: Column, turn_seconds: Column, speakers: Column, labels: Column) -> Column:
    """0 to 4: little overlap by time and by turns, turns that last, and as many main speakers as labels."""
    # The limits of the reference measure.
    tests = [overlap_time < 0.1, overlap_turns < 0.2, turn_seconds > 10, speakers == labels]
    score = F.lit(0)
    for t in tests:
        score = score + F.coalesce(t, F.lit(False)).cast("int")
    return score


def overlap_grade(share: Column) -> Column:
    """A name for the share of overlapping speech."""
    # Upper ends of the grades.
    grades = ((0.05, "excellent"), (0.1, "good"), (0.2, "moderate"), (0.3, "poor"))
    out = F.when(share.isNull(), F.lit(None).cast("string"))
    for most, name in grades:
        out = out.when(share <= most, name)
    return out.otherwise("very poor")


def is_high_quality(overlap_time: Column, overlap_turns: Column) -> Column:
    return (overlap_time < 0.1) & (overlap_turns < 0.2)
