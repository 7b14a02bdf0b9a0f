"""Command line: python -m parlance stats | search-podcast | search-episodes | columns, over a folder of Parquet files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog
from .sources import schema

TABLES = ("podcast_catalog", "episode_catalog", "category_index", "hostname_index", "speaker_name_index", "host_index", "host_episode_index", "guest_index", "guest_episode_index", "episode_metrics")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parlance", description="Searches and statistics of a conversation corpus.")
    sub = p.add_subparsers(dest="command", required=True)
    stats = sub.add_parser("stats", help="statistics of the corpus")
    show = sub.add_parser("search-podcast", help="a show by its title")
    show.add_argument("name")
    found = sub.add_parser("search-episodes", help="episodes that meet every criterion")
    for name in ("--min-duration", "--max-duration", "--min-speakers", "--max-speakers"):
        found.add_argument(name, type=int)
    for name in ("--host-name", "--category", "--subcategory"):
        found.add_argument(name)
    found.add_argument("--limit", type=int, default=10)
    columns = sub.add_parser("columns", help="columns of a table, or the tables")
    columns.add_argument("table", nargs="?", help="a table of the folder, or without a folder one of the registry")
    columns.add_argument("--grep", help="only columns whose name or type holds this")
    for each in (stats, show, found, columns):
        each.add_argument("--parquet-dir", required=each is not columns)
    return p


def lines(df: DataFrame) -> list[str]:
    """Rows of a small report as tab-separated lines under the names."""
    return ["\t".join(df.columns), *["\t".join("" if v is None else str(v) for v in r) for r in df.collect()]]


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    read = lambda name: spark.read.parquet(f"{args.parquet_dir}/metadata/{name}.parquet")
    if args.command == "columns" and args.parquet_dir is None:
        if args.table is None and not args.grep:
            return list(schema.TABLES)
        return lines(schema.describe(spark, args.table, args.grep))
    if args.command == "columns":
        if args.table is None:
            return list(TABLES)
        rows = [(f.name, f.dataType.simpleString()) for f in read(args.table).schema]
        return [f"{n}\t{t}" for n, t in rows if not args.grep or args.grep.lower() in f"{n}\t{t}".lower()]
    episodes = read("episode_catalog")
    if args.command == "stats":
        counted = lambda c: episodes.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(10)
        fields = [c for c in episodes.columns if c.startswith("category")]
        top = [catalog.category_distribution(episodes, fields).orderBy(F.desc("n"), "category").limit(10)] if fields else []
        parts = [catalog.corpus_statistics(episodes), *top, counted("language"), counted("num_main_speakers")]
        return "\n\n".join("\n".join(lines(p)) for p in parts).split("\n")
    if args.command == "search-podcast":
        show = catalog.find_show(read("podcast_catalog"), args.name)
        own = episodes.join(show.select("podcast_id"), "podcast_id", "left_semi")
        first = own.select("episode_id", "ep_title", "duration_seconds", "num_main_speakers").orderBy("episode_id").limit(5)
        return [*lines(show.select("podcast_id", "pod_title", "pod_description")), *lines(catalog.corpus_statistics(own)), *lines(first)]
    wanted = {k: getattr(args, k) for k in ("min_duration", "max_duration", "min_speakers", "max_speakers", "host_name", "category", "subcategory") if getattr(args, k) is not None}
    by_category = read("category_index") if args.category or args.subcategory else None
    by_host = read("host_episode_index") if args.host_name else None
    hits = catalog.search_episodes(episodes, categories=by_category, hosts=by_host, limit=args.limit, **wanted)
    return lines(hits.select("episode_id", "ep_title", "podcast_id", "duration_seconds", "num_main_speakers"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("parlance").getOrCreate()
    print("\n".join(run(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
