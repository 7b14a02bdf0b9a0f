"""A written trigram index for exact and regular-expression search.

Documents are numbered in the order of their keys, 64 to a block. A row of the index is a trigram in a block, with a bit for every
document that has it, so the and/or of a search is one of the bits of 64 documents at a time. A pattern becomes such a plan of
trigrams that every match must hold; what the plan leaves is then verified by the search itself, so the result is that of a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What lower case makes of characters that become an ASCII letter: A-Z, and the two others that do.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZKİ", "abcdefghijklmnopqrstuvwxyzki"
#: Trigrams that a plan uses of one run of characters, evenly spread, and in all; leaving some out only widens what is verified.
PER_RUN, MOST = 12, 64

#: A plan: None (any document), a trigram, or ("and" | "or", plans).
Plan = None | str | tuple


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def literal(run: str, fold: bool = False) -> Plan:
    """The plan of a run of characters; fold: as matched without regard to case, when only trigrams of ASCII are sure."""
    low = run.translate(str.maketrans(UPPER, LOWER))
    grams = [low[i : i + 3] for i in range(len(low) - 2)]
    grams = list(dict.fromkeys(g for g in grams if not fold or g.isascii()))
    step = max(1, -(-len(grams) // PER_RUN))
    return both(*grams[::step])


def both(*plans: Plan) -> Plan:
    known = list(dict.fromkeys(p for p in plans if p is not None))
    return None if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def either(*plans: Plan) -> Plan:
    return None if not plans or None in plans else plans[0] if len(set(plans)) == 1 else ("or", tuple(dict.fromkeys(plans)))


#: What Java's expressions and Python's parser read differently, or only one of them knows: such patterns get no plan.
_ODD = re.compile(r"&&|\\[^dDwWsSbBAZtnrf.\\\[\](){}|^$*+?/\-\"'!#%&,:;<=>@_`~ ]|\[\^?\]|\[[^\]]*\[|\(\?(?![:=!]|<[=!])|[*+?}]\+|\$\{")


def pattern_plan(pattern: str) -> Plan:
    """The plan of a regular expression: trigrams of its literal runs; alternatives are or, what may be absent asks for nothing."""
    from re import _parser as parser

    if _ODD.search(pattern):
        return None
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return _walk(tree)


def _walk(tree) -> Plan:
    found: list[Plan] = []
    run = ""

    def close() -> None:
        nonlocal run
        found.append(literal(run))
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name == "AT":  # takes no characters, but what follows need not follow on what came before in the text
            close()
            continue
        close()
        if name == "SUBPATTERN":
            found.append(_walk(arg[-1]))
        elif name == "BRANCH":
            found.append(either(*[_walk(x) for x in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found.append(_walk(arg[2]))
    close()
    return both(*found)


def query_plan(query: str, mode: str) -> Plan:
    """exact: every run of the query between white space, in any case. regex: of the pattern."""
    return pattern_plan(query) if mode == "regex" else both(*[literal(w, True) for w in query.lower().split()])


def _grams(plan: Plan) -> list[str]:
    return [] if plan is None else [plan] if isinstance(plan, str) else list(dict.fromkeys(g for p in plan[1] for g in _grams(p)))


def _bits(plan: Plan, of: dict[str, Column]) -> Column | None:
    """Bits of the documents that the plan leaves; a trigram that is not in `of` asks for nothing."""
    if isinstance(plan, str):
        return of.get(plan)
    parts = [_bits(p, of) for p in plan[1]]
    if plan[0] == "or":
        if any(p is None for p in parts):
            return None
    else:
        parts = [p for p in parts if p is not None]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.bitwiseAND(p) if plan[0] == "and" else out.bitwiseOR(p)
    return out


def _grams_of_blocks(placed: DataFrame) -> DataFrame:
    """(block, at, t) to gram, block, bits: each text is read once, from its first character to its last, and a row is a gram of all
    documents of a block that come in turn; a block that two tasks read has rows of both.
    """

    def put(block: int, bits: dict[str, int]) -> pa.RecordBatch:
        signed = [v - (1 << 64) if v >> 63 else v for v in bits.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(bits), pa.string()), pa.array([block] * len(signed), pa.int64()), pa.array(signed, pa.int64())], names=["gram", "block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, {}
        for b in batches:
            for block, at, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if block != now:
                    if bits:
                        yield put(now, bits)
                    now, bits = block, {}
                t, bit = t.as_py(), 1 << at
                for gram in map("".join, set(zip(t, t[1:], t[2:]))):
                    bits[gram] = bits.get(gram, 0) | bit
        if bits:
            yield put(now, bits)

    return placed.select("block", "at", F.make_valid_utf8("t").alias("t")).mapInArrow(run, "gram string, block long, bits long")


@dataclass(frozen=True)
class TrigramIndex:
    """grams: gram, block, bits; members: block, keys (up to 64, in the order of their bits)."""

    grams: DataFrame
    members: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TrigramIndex:
        return cls(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/members"))

    @classmethod
    def write(cls, docs: DataFrame, keys: list[str], text: str, path: str, parts: int = 64) -> TrigramIndex:
        """Indexes documents known by `keys`. Null texts match nothing and are left out.

        A row for each trigram and block, so a trigram of all documents has as many rows as there are blocks.
        """
        spark, number = docs.sparkSession, F.monotonically_increasing_id()  # per partition from a multiple of 2^33
        placed = docs.where(F.col(text).isNotNull()).select(F.struct(*keys).alias("key"), folded(F.col(text)).alias("t")).repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("__n", number)
        placed = placed.select("key", "t", F.shiftright("__n", 6).alias("block"), F.col("__n").bitwiseAND(F.lit(63)).cast("int").alias("at"))
        placed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/numbered")
        placed = spark.read.parquet(f"{path}/numbered")
        placed.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys")).write.mode("overwrite").parquet(f"{path}/members")
        bits = F.bit_or("bits").alias("bits")
        rows = _grams_of_blocks(placed.where(F.length("t") >= 3))
        rows.groupBy("gram", "block").agg(bits).repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/grams")
        return cls.open(spark, path)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.members.schema["keys"].dataType.elementType.fields]

    def matching(self, plan: Plan) -> DataFrame | None:
        """Keys of the documents that the plan leaves; None if it leaves all. The filter on gram reaches the scan."""
        wanted = _grams(plan)[:MOST]
        zero = F.lit(0).cast("bigint")
        left = None if plan is None else _bits(plan, {g: F.coalesce(F.max(F.when(F.col("gram") == g, F.col("bits"))), zero) for g in wanted})
        if left is None:
            return None
        blocks = self.grams.where(F.col("gram").isin(wanted)).groupBy("block").agg(left.alias("bits")).where("bits <> 0")
        at = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)
        held = self.members.join(blocks, "block").select(F.transform(at, lambda i: F.get("keys", i)).alias("keys"))
        return held.select(F.explode("keys").alias("key")).select("key.*")

    def candidates(self, docs: DataFrame, query: str, mode: str) -> DataFrame:
        """Of docs (of the indexed ones) those that may match the query."""
        keys = self.matching(query_plan(query, mode))
        return docs if keys is None else docs.join(keys, self.keys, "left_semi")
