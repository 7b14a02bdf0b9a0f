"""Tables of a conversation corpus: their columns, types and widths, and other names they go by."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Column:
    """A column: its type, the bytes a value takes on average, and what it holds."""

    kind: str
    width: int
    about: str


def _table(text: str) -> dict[str, Column]:
    """One column a line: name, type, width, description."""
    rows = (line.split(None, 3) for line in text.strip().splitlines())
    return {name: Column(kind, int(width), about) for name, kind, width, about in rows}


_NAMES = """
name_normalized string 75 trimmed and lower-cased name, which look-ups compare
name_original string 75 the name as it was first spelt
podcast_id string 69 the show
"""

# Names and types of the columns are the data's own.
TABLES: dict[str, dict[str, Column]] = {
    "turns": _table("""
episode_id string 73 the episode; with turn_count the key
podcast_id string 69 the show
speaker array<string> 120 all labels that speak in the turn, possibly none
turn_text string 265 what is said
start_time double 8 seconds from the episode's start
end_time double 8 seconds from the episode's start
duration double 8 end_time less start_time
turn_count int 4 the turn's number, which is not always the order in time
token_count int 8 tokens with times, punctuation included
inferred_speaker_name string 75 a name, or the sentinel for none
inferred_speaker_role string 71 host, guest, or the sentinel for none
speakers_recomputed boolean 1 whether labels were matched anew
"""),
    "turns_metrics": _table("""
episode_id string 73 the episode
turn_count int 4 the turn's number
word_count int 4 words between white space
words_per_second float 4 words by the turn's seconds
gap_from_prev float 4 silence since the turn before
overlap_with_prev float 4 seconds spoken over the turn before
discourse_marker_count smallint 2 fillers and markers
char_count int 4 characters
"""),
    "acoustics": _table("episode_id string 73 the episode\npodcast_id string 69 the show\nturn_count int 4 the turn's number\n" + "\n".join(f"{f}_{s} double 8 {s} of the feature over the turn" for f in ("mfcc1_sma3", "mfcc2_sma3", "mfcc3_sma3", "mfcc4_sma3", "f0_semitone_from_27_5hz_sma3nz", "f1_frequency_sma3nz") for s in ("mean", "stdev"))),
    "episodes": _table("""
episode_id string 73 16 digits of the audio address's md5
podcast_id string 69 12 digits of the feed address's md5
ep_title string 95 title, not unique within a show
mp3_url string 110 address of the audio
duration_seconds double 8 length
host_predicted_names array<string> 95 hosts named in the text
guest_predicted_names array<string> 95 guests named in the text
num_main_speakers bigint 8 speakers found
language string 55 language code
explicit bigint 8 1 if marked explicit
episode_date string 78 milliseconds since 1970 as text
overlap_prop_duration double 8 share of the time with several speakers
avg_turn_duration double 8 mean seconds of a turn
total_sp_labels bigint 8 labels assigned
""" + "\n".join(f"category{i} string 60 category {i} of the feed" for i in range(1, 11))),
    "podcasts": _table("""
podcast_id string 69 12 digits of the feed address's md5
rss_url string 110 address of the feed
pod_title string 85 title
pod_description string 400 description
language string 55 language code
explicit bigint 8 1 if marked explicit
image_url string 110 cover
itunes_author string 85 author
episode_count bigint 8 episodes
total_duration_seconds double 8 sum of lengths
primary_category string 60 first category by alphabet
all_categories array<string> 90 all categories
host_names array<string> 90 hosts by the feed
earliest_date string 78 first date
latest_date string 78 last date
"""),
    "episode_metrics": _table("""
episode_id string 73 the episode
podcast_id string 69 the show
total_word_count int 4 words of all turns
total_turn_count int 4 turns
unique_speaker_count int 4 different labels
avg_turn_duration double 8 mean seconds of turns that last
median_turn_duration double 8 median of them
avg_words_per_second double 8 words by seconds spoken
host_word_count int 4 words of hosts
guest_word_count int 4 words of guests
host_turn_proportion double 8 share of turns by hosts
host_word_proportion double 8 share of words by hosts
avg_gap_duration double 8 mean of the gaps above zero
total_overlap_duration double 8 sum of overlaps
discourse_marker_count int 4 markers
discourse_marker_rate double 8 markers in 1,000 words
speaking_rate_host double 8 hosts' words by their seconds
speaking_rate_guest double 8 guests' words by their seconds
"""),
    "guest_index": _table(_NAMES),
    "host_index": _table(_NAMES),
    "guest_episode_index": _table(_NAMES + "episode_id string 73 the episode"),
    "host_episode_index": _table(_NAMES + "episode_id string 73 the episode"),
    "speaker_name_index": _table(_NAMES + "episode_id string 73 the episode\nrole string 55 host or guest in that episode"),
    "category_index": _table("category string 60 category\npodcast_id string 69 the show"),
    "hostname_index": _table("hostname string 70 host of the feed's address\npodcast_id string 69 the show"),
    "shard_map": _table("podcast_id string 69 the show\ntree string 60 which table\npart string 70 file\nrow_group bigint 8 row group in it\nnum_rows bigint 8 rows"),
}
#: Names by which tables are known besides.
ALIASES = {
    "turns_text": "turns",
    "text": "turns",
    "turn": "turns",
    "metrics": "turns_metrics",
    "turn_metrics": "turns_metrics",
    "episode_catalog": "episodes",
    "podcast_catalog": "podcasts",
    "episode": "episodes",
    "podcast": "podcasts",
    "acoustic": "acoustics",
    "audio": "acoustics",
}
#: Bytes of a column that the registry does not know.
UNKNOWN_WIDTH = 100


def resolve_table(name: str) -> str:
    """The registry's name of a table, from it or an alias, case apart; else an error with the nearest names."""
    key = str(name).strip().lower()
    if key in TABLES:
        return key
    if key in ALIASES:
        return ALIASES[key]
    close = difflib.get_close_matches(key, [*TABLES, *ALIASES], 3)
    raise ValueError(f"no table {name!r}" + (f"; did you mean {', '.join(close)}?" if close else "") + f" There are {', '.join(TABLES)}.")


def describe(spark: SparkSession, table: str | None = None, grep: str | None = None) -> DataFrame:
    """table, column, type, width, about; of one table, and of columns whose name or description holds `grep`."""
    names = [resolve_table(table)] if table else list(TABLES)
    rows = [(t, c, x.kind, x.width, x.about) for t in names for c, x in TABLES[t].items()]
    if grep:
        rows = [r for r in rows if grep.lower() in r[1].lower() or grep.lower() in r[4].lower()]
    return spark.createDataFrame(rows, "table string, column string, type string, width int, about string")


#: Bytes of a value of the types whose values are all of one size.
SIZES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def measured(df: DataFrame, table: str) -> DataFrame:
    """table, column, type, width, about of the registry beside what a frame has: found (type), n_rows, n_null, mean_width (bytes of a value).

    One scan with partial sums, whose result is a row. Columns that the registry does not know have a null type; those that the frame
    lacks, a null found and null figures. A column without values has a null mean_width; what is nested is measured as JSON.
    A frame's columns of one name are rows of their own.
    """
    name, kinds = resolve_table(table), [f.dataType.simpleString() for f in df.schema.fields]
    rows = df.toDF(*[f"c{i}" for i in range(len(kinds))])
    sums = []
    for i, kind in enumerate(kinds):
        c = F.col(f"c{i}")
        nested = kind.startswith(("array", "map", "struct"))
        size = F.lit(SIZES[kind]) if kind in SIZES else F.octet_length(c if kind == "binary" else F.to_json(c) if nested else c.cast("string"))
        sums.append(F.struct(F.lit(df.columns[i]).alias("column"), F.lit(kind).alias("found"), F.count("*").alias("n_rows"), (F.count("*") - F.count(c)).alias("n_null"), F.round(F.avg(F.when(c.isNotNull(), size)), 6).alias("mean_width")))
    held = "column string, found string, n_rows bigint, n_null bigint, mean_width double"
    found = rows.agg(F.array(*sums).alias("z")).select(F.inline("z")) if sums else df.sparkSession.createDataFrame([], held)
    known = describe(df.sparkSession, name).drop("table")
    return known.join(found, "column", "full").select(F.lit(name).alias("table"), "column", "type", "width", "about", "found", "n_rows", "n_null", "mean_width")


def row_bytes(table: str | None, columns: list[str]) -> int:
    """Bytes that a row of these columns takes on the driver."""
    known = TABLES.get(table or "", {})
    return sum(known[c].width if c in known else UNKNOWN_WIDTH for c in columns)


def human_bytes(n: float) -> str:
    """1536 to '1.5 KB'."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def metadata_path(spark: SparkSession, folder: str, name: str, required: bool = True) -> str | None:
    """Path of a catalog below folder; if there is none, null or an error that says what is there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in (f"{folder}/metadata/{name}.parquet", f"{folder}/{name}.parquet"):
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    if not required:
        return None
    raise FileNotFoundError(f"no {name}.parquet in {folder} or {folder}/metadata; build the catalogs with parlance.operators.build")
