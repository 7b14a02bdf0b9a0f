"""A corpus: its tables as DataFrames, with look-ups, searches and frames over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions import taxonomy
from .operators import catalog, frames, names, search, windows
from .operators.index import TextIndex
from .operators.trigrams import TrigramIndex
from .sources import footers, schema

ORDER = ("episode_id", "start_time", "turn_count")


class Corpus:
    """Tables by their names in the registry (see sources.schema). Everything is lazy; nothing is kept on the driver.

    A restricted corpus sees some shows only, in every table but catalog(): those of its `shows` (podcast_id). index and trigrams
    are of its turns; groups are row groups by podcast_id (sources.footers) of tables.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], shows: DataFrame | None = None, index: TextIndex | None = None, trigrams: TrigramIndex | None = None, groups: dict[str, DataFrame] | None = None):
        self.spark, self.shows, self.index, self.trigrams = spark, shows, index, trigrams
        self._groups = {schema.resolve_table(k): v for k, v in (groups or {}).items()}
        self._tables = {schema.resolve_table(k): v for k, v in tables.items()}

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names_: tuple[str, ...] = ("turns", "episodes", "podcasts")) -> Corpus:
        return cls(spark, {n: spark.read.parquet(schema.metadata_path(spark, folder, n)) for n in names_})

    # tables

    def catalog(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A whole table, whatever the restriction."""
        key = schema.resolve_table(name)
        if key not in self._tables:
            raise FileNotFoundError(f"the corpus has no {key}; it has {', '.join(sorted(self._tables))}")
        table = self._tables[key]
        return table.select(*frames.checked_columns(table, columns))

    def table(self, name: str, columns: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table of the shows in view, or what some of its files (by name) hold of it."""
        whole = self.catalog(name)
        wanted = frames.checked_columns(whole, columns)
        if parts is not None:
            whole = frames.of_files(whole, parts)
        if self.shows is not None and "podcast_id" in whole.columns:
            whole = frames.pin(whole, self.shows)
        elif self.shows is not None and "episode_id" in whole.columns:
            whole = frames.pin(whole, frames.pin(self.catalog("episodes"), self.shows), "episode_id")
        return whole.select(*wanted)

    def of_show(self, name: str, podcast_id, columns: list[str] | None = None) -> DataFrame:
        """A show's rows of a table; files that cannot hold them are not opened where row groups are known, and row groups of other shows are skipped."""
        whole = self.table(name)
        wanted = frames.checked_columns(whole, columns)
        groups = self._groups.get(schema.resolve_table(name))
        if groups is not None:
            whole = frames.of_files(whole, footers.files_with(groups, podcast_id, whole.schema["podcast_id"].dataType.simpleString()))
        return whole.where(F.col("podcast_id") == podcast_id).select(*wanted)

    def restrict(self, ids: list | DataFrame) -> Corpus:
        """The corpus of some shows; ids that it has not go."""
        return Corpus(self.spark, self._tables, self.resolve(ids).select("podcast_id"), self.index, self.trigrams, self._groups)

    def resolve(self, ids: list | DataFrame) -> DataFrame:
        """(podcast_id, position): the ids that are in view, each once, in the given order."""
        if isinstance(ids, list):
            kind = self.catalog("podcasts").schema["podcast_id"].dataType.simpleString()
            ids = self.spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"podcast_id {kind}, position int")
        elif "position" not in ids.columns:
            ids = ids.select("podcast_id").distinct().withColumn("position", F.lit(0))
        return ids.join(self.table("podcasts", ["podcast_id"]), "podcast_id", "left_semi")

    def describe(self, table: str | None = None, grep: str | None = None) -> DataFrame:
        return schema.describe(self.spark, table, grep)

    def measured(self, name: str) -> DataFrame:
        """Columns of a table in view by the registry, beside their types, nulls and mean widths in the data."""
        return schema.measured(self.table(name), name)

    def files(self, name: str) -> list[str]:
        """Files behind a table."""
        return self.catalog(name).inputFiles()

    def chunks(self, name: str = "turns", columns: list[str] | None = None) -> Iterator[DataFrame]:
        """A frame per file of a table, for work that must go file by file."""
        whole = self.catalog(name)
        wanted = frames.checked_columns(whole, columns)
        for path in whole.inputFiles():
            part = Corpus(self.spark, {**self._tables, schema.resolve_table(name): frames.of_files(whole, [path])}, self.shows)
            yield part.table(name, wanted)

    def n_rows(self, name: str) -> int:
        """Rows of a whole table, by its row groups where they are known."""
        groups = self._groups.get(schema.resolve_table(name))
        return self.catalog(name).count() if groups is None else footers.total(groups)

    def parts_for(self, shows: list | DataFrame, trees: tuple[str, ...] = ()) -> DataFrame:
        """tree, part, n_shows: the files that hold some shows, by the shard map; what a download of these shows needs."""
        out = frames.pin(self.catalog("shard_map"), self.resolve(shows))
        out = out.where(F.col("tree").isin(*trees)) if trees else out
        return out.groupBy("tree", "part").agg(F.count_distinct("podcast_id").alias("n_shows"))

    def sql(self, query: str) -> DataFrame:
        """SQL over the tables in view, under their registry names."""
        for name in self._tables:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    # frames

    def turns(self, columns: list[str] | None = None, shows: list | None = None, episodes: list | None = None, with_metrics: bool = False, with_acoustics: bool = False, strict: bool = False, sort: bool = True) -> DataFrame:
        """Turns with their side tables and speaker columns, in order; `columns` keeps the keys besides."""
        some = self if shows is None else self.restrict(shows)
        out = some.table("turns")
        if episodes is not None:
            out = out.where(F.col("episode_id").isin(*episodes))
        out = frames.strict_turns(out) if strict else out
        for name, wanted in (("turns_metrics", with_metrics), ("acoustics", with_acoustics)):
            if wanted:
                side = self.catalog(name)
                out = frames.left_join_side(out, side.drop("podcast_id"), ["episode_id", "turn_count"], sorted(c for c in side.columns if c not in ("podcast_id", "episode_id", "turn_count")))
        out = frames.add_speaker_columns(out)
        if columns is not None:
            frames.checked_columns(out, columns)
            out = out.select(*dict.fromkeys([*columns, *(c for c in ("episode_id", "turn_count") if c in out.columns)]))
        return frames.in_turn_order(out) if sort else out

    def episodes(self, columns: list[str] | None = None, with_metrics: bool = False) -> DataFrame:
        """Episodes with published (timestamp) and day, and their metrics if asked for."""
        out = self.table("episodes")
        if with_metrics:
            side = self.catalog("episode_metrics").drop("podcast_id")
            out = frames.left_join_side(out, side, ["episode_id"], sorted(c for c in side.columns if c != "episode_id"))
        if "episode_date" in out.columns:
            out = out.withColumn("published", X.millis_timestamp(F.col("episode_date"))).withColumn("day", F.to_date("published"))
        return out.select(*frames.checked_columns(out, columns))

    def window_frame(self, size: int = 12, overlap: int = 0, **options) -> DataFrame:
        return windows.guarded_window_frame(self.turns(sort=False), size, overlap, schema.row_bytes("turns", ["episode_id", "turn_text", "speaker"]), **options)

    def collected(self, df: DataFrame, table: str | None = None, **limits):
        """pandas, if the frame's estimated size is not too much for the driver."""
        return frames.guard(df, schema.row_bytes(table, df.columns), **limits).toPandas()

    # look-ups

    def episode(self, episode_id) -> DataFrame:
        return self.table("episodes").where(F.col("episode_id") == episode_id).limit(1)

    def episodes_of(self, podcast_id, with_transcript: bool = False) -> DataFrame:
        """Episodes of a show, by date; without their transcripts if not asked for."""
        out = catalog.by_date(self.table("episodes").where(F.col("podcast_id") == podcast_id))
        return out if with_transcript or "transcript" not in out.columns else out.drop("transcript")

    def turns_of(self, episode_id, with_acoustics: bool = False) -> DataFrame:
        """Turns of an episode in time, those of one start in the order of their numbers."""
        return self.turns(episodes=[episode_id], with_acoustics=with_acoustics, sort=False).orderBy("start_time", "turn_count")

    def metrics_of(self, episode_id) -> DataFrame:
        return self.table("episode_metrics").where(F.col("episode_id") == episode_id).limit(1)

    def turn_metrics_of(self, podcast_id, episode_id) -> DataFrame:
        """Turn metrics of an episode; a show that is not in view is an error, an episode without metrics gives no rows."""
        if not self.has(podcast_id):
            raise KeyError(f"no show {podcast_id!r}")
        return self.table("turns_metrics").where(F.col("episode_id") == episode_id).orderBy("turn_count")

    def counts(self) -> DataFrame:
        """n_shows, n_episodes in view."""
        return self.table("episodes").agg(F.count("*").alias("n_episodes")).withColumn("n_shows", self.table("podcasts").agg(F.count_distinct("podcast_id")).scalar())

    def __len__(self) -> int:
        return self.table("episodes").count()

    def show_ids(self, position: str = "podcast_id") -> DataFrame:
        return self.table("podcasts").select("podcast_id", position).distinct().orderBy(position).select("podcast_id")

    def has(self, podcast_id) -> bool:
        return not self.table("podcasts").where(F.col("podcast_id") == podcast_id).isEmpty()

    def show(self, title: str | None = None, podcast_id=None) -> DataFrame:
        """A show by its id, or by title: equal case apart, else the first that holds it."""
        shows = self.table("podcasts")
        return shows.where(F.col("podcast_id") == podcast_id).limit(1) if title is None else catalog.find_show(shows, title)

    def with_show(self, rows: DataFrame, columns: tuple[str, ...] = ("pod_title",)) -> DataFrame:
        """Rows of episodes or turns with columns of their show."""
        return rows.join(self.catalog("podcasts").select("podcast_id", *columns), "podcast_id")

    # searches

    def search_episodes(self, max_episodes: int | None = None, sampling: str = "first", seed: int = 0, **criteria) -> DataFrame:
        """Episodes by the criteria of catalog.search_episodes, through the corpus' indexes where there are any."""
        part = {k: self._tables.get(v) for k, v in (("categories", "category_index"), ("hosts", "host_episode_index"), ("guests", "guest_episode_index"))}
        return catalog.search_episodes(self.table("episodes"), self.catalog("podcasts"), limit=max_episodes, sampling=sampling, seed=seed, **part, **criteria)

    def episodes_of_subcategory(self, subcategory: str, **options) -> DataFrame:
        """Episodes of shows with a subcategory, which must be one of the taxonomy."""
        if subcategory not in taxonomy.MAIN_OF:
            raise ValueError(f"{subcategory!r} is no subcategory")
        return self.search_episodes(subcategory=subcategory, **options)

    def shows_by_category(self, category: str) -> DataFrame:
        return catalog.shows_by_category(self.table("podcasts"), self.catalog("category_index"), category)

    def shows_by_hostname(self, hostname: str) -> DataFrame:
        return catalog.shows_by_hostname(self.table("podcasts"), self.catalog("hostname_index"), hostname)

    def shows_by_host(self, name: str, exact: bool = False) -> DataFrame:
        return catalog.shows_by_name(self.table("podcasts"), self.catalog("host_index"), name, exact)

    def shows_by_guest(self, name: str, exact: bool = False) -> DataFrame:
        return catalog.shows_by_name(self.table("podcasts"), self.catalog("guest_index"), name, exact)

    def episodes_by_host(self, name: str, exact: bool = False, limit: int | None = None) -> DataFrame:
        return catalog.episodes_by_name(self.table("episodes"), self.catalog("host_episode_index"), name, exact, limit)

    def episodes_by_guest(self, name: str, exact: bool = False, limit: int | None = None) -> DataFrame:
        return catalog.episodes_by_name(self.table("episodes"), self.catalog("guest_episode_index"), name, exact, limit)

    def names(self, name: str, role: str | None = None, exact: bool = False, limit: int | None = None) -> DataFrame:
        """Rows of the speaker index with a name."""
        found = names.lookup(self.table("speaker_name_index"), name, exact, role)
        return found if limit is None else found.orderBy("name_normalized", "episode_id", "role").limit(limit)

    def search_turns(self, query: str, mode: str = "fts", limit: int = 100, offset: int = 0, **where) -> DataFrame:
        return search.search_turns(self._text(), query, mode, limit, offset, self.index, self.trigrams, self.shows is not None, **where)

    def search_episodes_by_text(self, query: str, mode: str = "fts", limit: int | None = 100) -> DataFrame:
        return search.episodes_by_text(self._text(), query, mode, limit, self.index, self.shows is not None)

    def concordance(self, word: str, context: int = 10, limit: int | None = None, **where) -> DataFrame:
        some = search.select_turns(self._text(), **where)
        some = some if self.trigrams is None else self.trigrams.candidates(some, word, "exact")
        hits = search.concordance(some, word, context)
        return hits if limit is None else hits.orderBy("episode_id", "turn_count").limit(limit)

    def word_times(self, episode_id, word: str) -> DataFrame:
        return search.word_positions(self.table("turns").where(F.col("episode_id") == episode_id), word)

    def filter_episodes_by_metrics(self, limit: int = 10_000, **ranges: tuple) -> DataFrame:
        return catalog.filter_by_metrics(self.table("episode_metrics"), limit, **ranges)

    def iterate_episodes(self, limit: int | None = None, sampling: str = "first", seed: int = 0):
        return catalog.iterate(self.table("episodes"), "episode_id", limit, sampling, seed)

    def iterate_shows(self, limit: int | None = None, sampling: str = "first", seed: int = 0):
        return catalog.iterate(self.table("podcasts"), "podcast_id", limit, sampling, seed)

    def statistics(self, categories: list[str]) -> tuple[DataFrame, DataFrame]:
        """Totals, and the histograms of categories, languages and speakers, of the shows in view."""
        some = self.table("episodes")
        return catalog.corpus_statistics(some), catalog.corpus_profile(some, categories)

    def _text(self) -> DataFrame:
        """Turns with `role`, whatever the table calls it."""
        out = self.table("turns")
        return out if "role" in out.columns else out.withColumnRenamed("inferred_speaker_role", "role")
