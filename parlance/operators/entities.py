"""Names of a list found in texts by an automaton: all of them in one pass over a text, the longest first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that the names of a list may have in all, as every task holds the list; longer lists are to be split.
LARGEST = 64 << 20
_SPACE = re.compile(r"\s+")


def squashed(name: str) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return _SPACE.sub(" ", name.lower()).strip()


def _names(gazetteer: DataFrame, name: str) -> list[str]:
    rows = gazetteer.select(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")).alias("n")).where("n <> ''").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("n")), F.lit(0))).first()[0]
    if size > LARGEST:
        raise ValueError(f"the list has {size} characters, more than {LARGEST}; split it and unite what its parts find")
    return sorted({squashed(r.n) for r in rows.collect()})


def mentions(docs: DataFrame, gazetteer: DataFrame, text: str, name: str = "name") -> DataFrame:
    """docs without its text, a row per mention: entity (a name of the list, lower case), position (0-based, in the squashed text).

    Names match whole words, without regard to case or the kind of white space; a character of [0-9A-Za-z_] or beyond ASCII that is
    a letter or number makes a word go on. From left to right the name that begins first is taken, of those that begin together the
    longest, and nothing within it. Null texts have no mentions; other columns stay, but entity and position are an error. The
    list is broadcast after its size is checked; texts are read where they are.
    """
    if {"entity", "position"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns entity and position exist already; rename them first")
    names = docs.sparkSession.sparkContext.broadcast(_names(gazetteer, name))  # at most LARGEST characters
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in names.value:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for b in batches:
            rows, found, places = [], [], []
            for i, t in enumerate(b.column(at).to_pylist() if names.value else []):
                for start, n in leftmost(automaton, squashed(t)) if t else ():
                    rows.append(i)
                    found.append(n)
                    places.append(start)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(take) for j, c in enumerate(b.columns) if j != at], pa.array(found, pa.string()), pa.array(places, pa.int64())], names=[*[f.name for f in kept], "entity", "position"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("entity", T.StringType()), T.StructField("position", T.LongType())]))


def _goes_on(c: str) -> bool:
    return c.isalnum() or c == "_"


def leftmost(automaton, text: str) -> Iterator[tuple[int, str]]:
    """(place, name) of whole-word hits, the leftmost and longest of those that overlap."""
    hits = []
    for last, name in automaton.iter(text):
        start = last - len(name) + 1
        whole = (start == 0 or not (_goes_on(text[start - 1]) and _goes_on(name[0]))) and (last + 1 == len(text) or not (_goes_on(text[last + 1]) and _goes_on(name[-1])))
        if whole:
            hits.append((start, -len(name), name))
    end = 0
    for start, less, name in sorted(hits):
        if start >= end:
            yield start, name
            end = start - less
