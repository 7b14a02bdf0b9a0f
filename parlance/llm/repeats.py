"""Removal of long byte strings that occur more than once, by bounded interval expansion on a Burrows-Wheeler transform.

Windows of LENGTH bytes are dealt so that equal windows meet: each window's anchor is the string of GRAM bytes in it with the
least hash (the first, of ties). Windows next to each other that share an anchor form a run, and every window is in exactly one
run. Only runs whose anchor stands elsewhere too can repeat. Runs with equal bytes repeat as a whole and are kept once. The
bytes of what is left, a small part of the corpus, go to tasks by anchor. A task leaves out windows whose anchor, with half of
their other bytes, stands in no other run (see below). It sorts the suffixes of the rest, and expands intervals of the
transform backwards, breadth first: level n yields the places where neighbouring suffixes share exactly n bytes, and after
level LENGTH - 1 the places without a value are the repeats.

An anchor with more than HOT different runs is split before that. Every window of it reaches at least half of the bytes that it
holds besides the anchor to the left, or else to the right; so a run falls into two, whose keys are the anchor with that
many bytes more on one side, and equal windows still meet. What is hot by its new key is split again, until after ten
rounds at most a key is a whole window.

Texts with the same bytes are one text with a number of copies from the start, and all their windows repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .store import in_batches, materialize, table

LENGTH, GRAM = 400, 100
#: Windows hashed at once (the place of an anchor has 20 bits), bytes of one transform, and different runs of an anchor that are not split.
PIECE, BATCH, HOT = 1 << 18, 1 << 20, 256

_U = np.uint64
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, _U)
_ODD = _RNG.integers(0, 1 << 63, 16, _U) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _ODD[8]
    return h ^ (h >> _U(29))


def digest(raw: bytes | memoryview, seed: int) -> int:
    """What stands for equal bytes. Not a polynomial: by one modulo 2^64, different Thue-Morse words are equal under any odd base."""
    return xxh64_intdigest(raw, seed) - (1 << 63)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each string of `gram` bytes, from those of half its length and so on."""
    h, size, out, done = _BYTE[data], 1, None, 0
    left = gram
    while left:
        if left & size:
            part = h[done : done + len(data) - gram + 1]
            out = _mix(part * _ODD[0]) if out is None else _mix(out * _ODD[1] + part)
            done += size
            left -= size
        if left:
            h = _mix(h[:-size] * _ODD[2] + h[size:])
            size *= 2
    return out


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    size = 1
    n = len(v) - width + 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def window_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of texts at `first` with `size` bytes in data (shorter than PIECE + length): text, start in it, windows, anchor hash, hash of the run's bytes."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = gram_hashes(data, gram)
    tagged = ((grams >> _U(20)) << _U(20)) | np.arange(len(grams), dtype=_U)
    least = _least(tagged, length - gram + 1)
    owner = np.repeat(np.arange(len(first)), size)[: len(least)]
    valid = np.zeros(len(least), bool)
    for f, n in zip(first.tolist(), size.tolist(), strict=True):
        if n >= length:
            valid[f : f + n - length + 1] = True
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    anchor = grams[(least[at] & _U((1 << 20) - 1)).astype(np.int64)]
    view = memoryview(data)
    content = np.array([digest(view[a:z], 99) for a, z in zip(at.tolist(), (ends + length).tolist(), strict=True)], np.int64)
    return owner[at], at - first[owner[at]], ends - at + 1, anchor.view(np.int64), content


def runs_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, k1, k2, text) to doc_id, k1, k2 and runs (array of start, windows, anchor, content)."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [(t.as_py() or "").encode() for t in b.column(3)]
            parts: list[list[tuple]] = [[] for _ in raws]
            held: list[tuple[int, int, bytes]] = []  # text, where its piece starts, piece

            def flush(held: list, parts: list) -> None:
                size = np.array([len(x[2]) for x in held], np.int64)
                found = window_runs(np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.cumsum(size) - size, size, length, gram)
                for i, start, *rest in zip(*(x.tolist() for x in found), strict=True):
                    parts[held[i][0]].append((start + held[i][1], *rest))
                held.clear()

            n = 0
            for i, raw in enumerate(raws):
                for at in range(0, max(0, len(raw) - length + 1), PIECE):
                    piece = raw[at : at + PIECE + length - 1]
                    if n + len(piece) > PIECE + length and held:
                        flush(held, parts)
                        n = 0
                    held.append((i, at, piece))
                    n += len(piece)
            if held:
                flush(held, parts)
            names = ["start", "windows", "anchor", "content"]
            offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            flat = np.array([x for p in parts for x in p], np.int64).reshape(-1, 4)
            values = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(4)], names=names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets, values).cast(run_type)],
                names=["doc_id", "k1", "k2", "runs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "k1", "k2", "text"), run, f"doc_id {kind}, k1 long, k2 long, runs array<struct<start:long,windows:long,anchor:long,content:long>>")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes (of numbers below 512) in the order of their first `depth` symbols at least, by prefix tripling, or doubling where three ranks exceed 63 bits."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    size, bits = 7, n.bit_length()
    while True:
        order = np.argsort(key)  # suffixes with equal prefixes of `depth` may stand in any order
        changes = np.append(1, (np.diff(key[order]) != 0).astype(np.int64))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changes)
        if size >= depth or rank[order[-1]] == n:
            return order
        key, times = rank, 3 if 3 * bits < 64 else 2
        for at in range(size, times * size, size):
            key = key << bits
            key[: max(0, n - at)] |= rank[at:]
        size *= times


def repeated(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places whose next `length` symbols also begin elsewhere.

    shared[r] is how long the common prefix of the suffixes r - 1 and r is, known (true here) once its level has been worked.
    Level by level, an interval of suffixes with a common prefix gives, for each symbol before them, the interval of the
    prefix that is longer by that symbol; if the end of that one is not known yet, its value is the level.
    """
    n = len(symbols)
    order = suffix_order(symbols, length)
    before = symbols[order - 1].astype(np.int64)
    step = np.empty(n, np.int64)
    step[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high, bits = np.array([0]), np.array([n]), n.bit_length()
    for _ in range(length):
        if not len(low):
            break
        one = high - low == 1
        x, y = step[low[one]], step[low[one]] + 1
        if not one.all():
            a, size = low[~one], (high - low)[~one]
            ends = np.cumsum(size)
            rows = np.repeat(a - ends + size, size) + np.arange(ends[-1])
            held = np.sort(((np.repeat(np.arange(len(a)), size) * 512 + before[rows]) << bits) | rows)  # by interval, symbol and row
            cut = np.flatnonzero(np.diff(held >> bits)) + 1
            rows = held & ((1 << bits) - 1)
            x = np.append(x, step[rows[np.append(0, cut)]])
            y = np.append(y, step[rows[np.append(cut, len(rows)) - 1]] + 1)
        new = ~known[y]
        x, y = x[new], y[new]
        y, first = np.unique(y, return_index=True)  # of two prefixes that end at one place, either tells its value
        x = x[first]
        known[y] = True
        low, high = x, y
    both = ~known[:-1] | ~known[1:]
    return order[both]


def repeated_windows(contents: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per content the ranges (from, past the end) of its windows that occur twice or more among the contents."""
    sizes = np.array([len(c) for c in contents])
    symbols = np.frombuffer(b"\0".join([*contents, b""]), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    starts = ends - sizes
    at = np.sort(repeated(symbols, length))
    owner = np.searchsorted(ends, at)
    fits = at + length <= ends[np.minimum(owner, len(ends) - 1)]
    at, owner = at[fits], owner[fits]
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    if len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(at)).tolist(), strict=True):
            out[owner[a]].append((int(at[a] - starts[owner[a]]), int(at[b - 1] - starts[owner[a]]) + 1))
    return out


def _contents(asked: DataFrame, length: int) -> DataFrame:
    """(text, wanted: start, windows, anchor, content) to key, piece, bytes, x, y: the runs' bytes (x and y null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, content, raws = [], [], []
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    anchor.append(w["anchor"])
                    content.append(w["content"])
                    raws.append(raw[w["start"] : w["start"] + w["windows"] + length - 1])
            none = pa.nulls(len(raws), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(raws, pa.binary()), none, none], names=["key", "piece", "bytes", "x", "y"])

    return in_batches(asked.select("text", "wanted"), run, PIECES)


PIECES = "key long, piece long, bytes binary, x long, y long"


def anchor_of(window: bytes, gram: int = GRAM) -> int:
    """Where the anchor of a window starts in it."""
    return int(np.argmin(gram_hashes(np.frombuffer(window, np.uint8), gram) >> _U(20)))


def halves(raw: bytes, x: int, y: int, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """A run whose windows all hold its bytes x to y, in two: first window, past the last, side, and x and y with half of what windows hold besides."""
    windows, half = len(raw) - length + 1, (length - (y - x) + 1) // 2
    cut = min(max(0, x - half + 1), windows)  # the windows before this one reach that far to the left of x
    return [(a, b, side, *at) for a, b, side, at in ((0, cut, 0, (x - half, y)), (cut, windows, 1, (x, y + half))) if b > a]


def meeting(keys: list[int], raws: list[bytes], xs: list[int | None], ys: list[int | None], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Pieces without the half of their windows (see halves) that no other piece of their key can hold: piece, first window, past the last. Whole keys are given."""
    grams = gram_hashes(np.frombuffer(b"".join(raws), np.uint8), gram) >> _U(20)
    parts, count, start = [], Counter(), 0
    for key, raw, x, y in zip(keys, raws, xs, ys, strict=True):
        if x is None:
            x = int(np.argmin(grams[start : start + length - gram + 1]))  # as anchor_of
            y = x + gram
        start += len(raw)
        parts.append([(a, b, (key, side, raw[c:d])) for a, b, side, c, d in halves(raw, x, y, length)])
        count.update(held for _, _, held in parts[-1])
    kept = [[p for p in own if count[p[2]] > 1] for own in parts]
    return [(i, own[0][0], own[-1][1]) for i, own in enumerate(kept) if own]


def _split(pieces: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Hot pieces to their halves: p_key, p_piece, off (where the half's first window stands), windows, and the half's own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, piece, raw, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if x is None:
                    x = anchor_of(raw[:length], gram)
                    y = x + gram
                for first, past, side, new_x, new_y in halves(raw, x, y, length):
                    part = raw[first : past + length - 1]
                    rows.append((key, piece, first, past - first, digest(raw[new_x:new_y], 2 * level + side), digest(part, 99), part, new_x - first, new_y - first))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=["p_key", "p_piece", "off", "windows", "key", "piece", "bytes", "x", "y"])

    return in_batches(pieces.select("key", "piece", "bytes", "x", "y"), run, f"p_key long, p_piece long, off long, windows long, {PIECES}")


def _expanded(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """PIECES, dealt and sorted by key, to key, piece, low, high (ranges of its windows that repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, raws, xs, ys, total = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            met = meeting(keys, raws, xs, ys, length, gram)
            found = repeated_windows([raws[i][first : past + length - 1] for i, first, past in met], length) if met else []
            rows = [(keys[i], names[i], first + a, first + b) for (i, first, _), ranges in zip(met, found, strict=True) for a, b in ranges]
            for held in (keys, names, raws, xs, ys):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["key", "piece", "low", "high"])

        for b in batches:
            for key, piece, raw, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if total > BATCH and key != keys[-1]:
                    yield flush()
                    total = 0
                keys.append(key)
                names.append(piece)
                raws.append(raw)
                xs.append(x)
                ys.append(y)
                total += len(raw)
        if keys:
            yield flush()

    return in_batches(pieces.select("key", "piece", "bytes", "x", "y"), run, "key long, piece long, low long, high long")


def repeated_ranges(pieces: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, level: int = 0) -> DataFrame:
    """(key, piece, low, high): ranges of the windows of pieces that other pieces of their key hold too. pieces: a written table of PIECES.

    A task holds at most `hot` pieces of a key at once, whatever their number.
    """
    sizes = pieces.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select(F.col("key").alias("m_key"), (F.col("d") > hot).alias("hot"))
    sizes = materialize(sizes, "piece-keys")
    met = pieces.join(sizes, F.col("key") == F.col("m_key")).drop("m_key")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _expanded(met.where("not hot").repartition(n, F.xxhash64("key")).sortWithinPartitions("key", "piece"), length, gram)
    if sizes.where("hot").isEmpty():
        return materialize(found, "ranges")
    parts = materialize(_split(met.where("hot"), level, length, gram), "halves")
    below = parts.groupBy("key", "piece").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("bytes", "x", "y")])  # copies are combined before the shuffle
    below = materialize(below, "pieces")
    whole = below.where("n > 1").select("key", "piece", F.lit(0).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"))
    inner = repeated_ranges(below.drop("n"), length, gram, hot, level + 1).unionByName(whole).toDF("f_key", "f_piece", "low", "high")
    up = parts.drop("bytes").join(inner, (F.col("key") == F.col("f_key")) & (F.col("piece") == F.col("f_piece")))
    up = up.select(F.col("p_key").alias("key"), F.col("p_piece").alias("piece"), (F.col("off") + F.col("low")).alias("low"), (F.col("off") + F.coalesce("high", "windows")).alias("high"))
    return materialize(found.unionByName(up), "ranges")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, text, whole, ranges) to doc_id, n_bytes, spans, kept."""
    span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, spans, kept = [], [], []
            for text, whole, ranges in zip(*b.columns[1:], strict=True):
                raw = (text.as_py() or "").encode()
                n_bytes.append(len(raw))
                own: list[list[int]] = []
                if whole.as_py():
                    own.append([0, len(raw)])
                elif ranges.is_valid:
                    for low, high in sorted((r["low"], r["high"] + length - 1) for r in ranges.as_py()):
                        if own and low <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], high)
                        else:
                            own.append([low, high])
                spans.append([{"low": low, "high": high} for low, high in own])
                edges = [0, *(x for pair in own for x in pair), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows.select("doc_id", "text", "whole", "ranges"), run, f"doc_id {kind}, n_bytes long, spans array<struct<low:long,high:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (low, high: maximal runs of bytes that go), kept (binary: the bytes that stay) of every row of (doc_id, text).

    Null text is empty. Texts below `length` bytes are never touched; longer ones of any size are hashed in pieces. A repeated row
    is a copy: all of its windows repeat, whatever their order. An empty table gives an empty result; of extra columns, whatever
    their names, none is read.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("k2"), "text")
    prints = materialize(runs_of(keyed, length, gram), "runs")
    texts = prints.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("runs").alias("runs"))
    texts = materialize(texts, "texts").withColumn("long", F.size("runs") > 0)
    runs = texts.where("long").select("k1", "k2", "doc_id", F.explode("runs").alias("r")).select("k1", "k2", "doc_id", "r.*")
    anchors = materialize(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("a")), "anchors")
    near = materialize(runs.join(anchors, F.col("anchor") == F.col("a")).drop("a"), "near-runs")
    one = near.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "doc_id", "start", "windows")).alias("at"))
    one = materialize(one, "contents")
    mixed = materialize(one.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1").select(F.col("anchor").alias("a")), "mixed-anchors")
    wanted = one.join(mixed, F.col("anchor") == F.col("a")).groupBy("at.k1", "at.k2", "at.doc_id").agg(F.collect_list(F.struct("at.start", "at.windows", "anchor", "content")).alias("wanted")).toDF("w1", "w2", "w_id", "wanted")
    same_text = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    fetched = materialize(_contents(keyed.join(materialize(wanted, "wanted"), same_text), length).dropDuplicates(["key", "piece"]), "run-bytes")
    whole = one.where("n > 1").select(F.col("anchor").alias("key"), F.col("content").alias("piece"), F.lit(0).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"))
    found = materialize(repeated_ranges(fetched, length, gram, hot).unionByName(whole), "found")
    hits = near.join(found, (F.col("content") == F.col("piece")) & (F.col("anchor") == F.col("key")))
    hits = hits.select("k1", "k2", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.coalesce("high", "windows")).alias("high")).alias("r"))
    spans = hits.groupBy("k1", "k2").agg(F.collect_list("r").alias("ranges")).select("k1", "k2", F.lit(False).alias("whole"), "ranges")  # of one text
    copied = texts.where("long and copies > 1").select("k1", "k2", F.lit(True).alias("whole"), F.lit(None).cast(spans.schema["ranges"].dataType).alias("ranges"))
    touched = spans.unionByName(copied).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.max("ranges").alias("ranges")).toDF("t1", "t2", "whole", "ranges")
    rows = keyed.join(materialize(touched, "decisions"), (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    return _cut(rows, length)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that also start elsewhere.

    text is what stays; where a cut went through a character, its remaining bytes read as U+FFFD there, but not in kept_sha256.
    """
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["high"] - s["low"])
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text, "spans")
