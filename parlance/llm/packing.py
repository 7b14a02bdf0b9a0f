"""Best-fit packing of token sequences with a matching of large items.

Only how many pieces there are of each length matters to a plan, and lengths end at the capacity, so the plan is made on the
driver from a histogram of at most `capacity` counts, whatever the corpus. Pieces above a third of the capacity meet at
most in twos: from the longest down, each takes the longest partner that still fits, which leaves as few bins as any
matching. Shorter pieces, longest first, go where the least room is left over. A plan is a list of runs of equal bins;
every piece finds its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import in_batches, materialize, reserve, table

CAPACITY, END = 1024, 2
#: The vocabulary's added token and its id: a text is cut there before words are.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Pieces are ranked within (length, salt), salts being as many as leave the commonest length so many rows for each: no length is ranked
#: in one task. Sums over salts are taken FAN at a time.
RANKED, FAN = 256, 256
#: Slots (as a power of two) and ids of the table of words that a Python worker keeps; when it is full it starts afresh.
SLOTS, MEMORY = 20, 8_000_000
#: Characters that are split at once.
CHUNK = 1 << 18


def _classes() -> np.ndarray:
    """By code point: 0 letter, 1 number, 2 white space, 3 anything else (the classes of the pre-tokenizer's pattern)."""
    kinds = np.fromiter(({"L": 0, "N": 1}.get(unicodedata.category(chr(i))[0], 3) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[[*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]] = 2
    return kinds


class Encoder:
    """Ids of the byte-level BPE vocabulary, a chunk of texts at once.

    Words are cut as the vocabulary's pre-tokenizer cuts them, with array operations. Each word is looked up by a 64-bit hash in
    a table of fixed size and compared with the word that it holds, as hashes can be made to collide; words that are not there are encoded by tiktoken from the same vocabulary (tests hold the ids against
    tokenizers). Texts above CHUNK characters are cut at a space between words, where cutting changes nothing.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kinds = _classes()
        rng = np.random.default_rng(42)
        self.code = rng.integers(0, 1 << 64, sys.maxunicode + 1, np.uint64)
        self.base = np.uint64(rng.integers(0, 1 << 62) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
        self.store, self.used = np.zeros(1 << 20, np.uint32), 0
        self.word, self.long_ = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
        self.letters, self.written = np.zeros(1 << 20, np.uint32), 0

    def put(self, name: str, used: str, values: np.ndarray) -> int:
        """Appends to one of the two stores, which grow; where the values start."""
        start = getattr(self, used)
        while start + len(values) > len(getattr(self, name)):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(len(getattr(self, name)), np.uint32)]))
        getattr(self, name)[start : start + len(values)] = values
        setattr(self, used, start + len(values))
        return start

    def starts(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where tokens of the pre-tokenizer start. ends: places of the marks after each text; they are tokens of their own."""
        kind = self.kinds[code]
        kind[ends] = 4
        start = np.ones(len(code), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[ends] = True
        after = np.flatnonzero((kind[1:] != 2) & (kind[1:] != 4) & (kind[:-1] == 2)) + 1
        start[after - 1] = True  # of a run of white space, the last character is apart
        start[after] = code[after - 1] != 32  # and a space belongs to what follows
        for q in np.flatnonzero((code == 39) & start)[:].tolist():
            if kind[q + 1] == 0:
                two = "".join(map(chr, code[q + 1 : q + 3].tolist()))
                n = 2 if two in ("re", "ve", "ll") else 1 if two[0] in "stmd" else 0
                if n:
                    start[q + 1] = False
                    if kind[q + 1 + n] == 0:
                        start[q + 1 + n] = True
        return np.flatnonzero(start)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(t) > 2 * CHUNK for t in texts):
            return [self.long(t) if len(t) > 2 * CHUNK else self.ids([t])[0] for t in texts]
        whole = "\0".join([*texts, ""])
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        if len(code) >= len(self.powers):
            n = max(len(code) + 1, CHUNK)
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))
        first = self.starts(code, ends)
        last = np.append(first[1:], len(code))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[code] * self.powers[: len(code)], dtype=np.uint64)])
        key = (total[last] - total[first]) * self.inverses[first]
        key ^= (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key |= np.uint64(1)
        mark = np.zeros(len(code), bool)
        mark[ends] = True
        mark = mark[first]
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        size[mark] = 0
        length = last - first
        hit = (self.keys[slot] == key) & (self.long_[slot] == length) & ~mark
        held = np.flatnonzero(hit)
        hit[held] = same(self.letters, self.word[slot[held]], code, first[held], length[held])
        lost = np.flatnonzero(~hit & ~mark)
        if len(lost):
            new, where, back = np.unique(key[lost], return_index=True, return_inverse=True)
            chosen = lost[where]
            if (self.used + len(new)) * 8 > MEMORY or (self.written + int(length[chosen].sum())) * 4 > 4 * MEMORY:
                self.forget()
                return self.ids(texts) if len(new) * 8 < MEMORY and int(length[chosen].sum()) < MEMORY else [np.array(self.encode(t), np.uint32) for t in texts]
            a, b = first[chosen].tolist(), last[chosen].tolist()
            found = [self.encode(whole[i:j]) for i, j in zip(a, b, strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            places = self.put("store", "used", np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))) + np.cumsum(sizes) - sizes
            spans = length[chosen]
            words = self.put("letters", "written", code[np.repeat(first[chosen] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))]) + np.cumsum(spans) - spans
            slots = (new >> np.uint64(64 - SLOTS)).astype(np.int64)
            self.keys[slots], self.at[slots], self.size[slots], self.word[slots], self.long_[slots] = new, places, sizes, words, spans  # of two new words for one slot, the last stays
            at[lost], size[lost] = places[back], sizes[back]
            other = np.flatnonzero(length[lost] != spans[back])
            alike = np.flatnonzero(length[lost] == spans[back])
            other = np.concatenate([other, alike[~same(code, first[chosen][back[alike]], code, first[lost[alike]], length[lost[alike]])]])
            for k in lost[other].tolist():  # another word of the same hash
                ids = np.array(self.encode(whole[first[k] : last[k]]), np.uint32)
                at[k], size[k] = self.put("store", "used", ids), len(ids)
        done = np.cumsum(size)
        out = self.store[np.repeat(at - done + size, size) + np.arange(int(done[-1]))]
        return np.split(out, done[mark])[:-1]

    def long(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = at + CHUNK
            while cut < len(text) and not (text[cut] == " " and self.kinds[ord(text[cut - 1])] != 2 and self.kinds[ord(text[min(cut + 1, len(text) - 1)])] == 0):
                cut += 1
            parts.append(text[at:cut])
            at = cut
        return np.concatenate([self.ids([p])[0] if len(p) <= 2 * CHUNK else np.array(self.encode(p), np.uint32) for p in parts])


def same(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether runs of a and b, each of a length of one or more, are equal."""
    if not len(length):
        return np.zeros(0, bool)
    before = np.cumsum(length) - length
    step = np.arange(int(before[-1] + length[-1])) - np.repeat(before, length)
    return np.add.reduceat(a[np.repeat(a_start, length) + step] != b[np.repeat(b_start, length) + step], before) == 0


def with_added(encoder: Encoder, texts: list[str]) -> list[np.ndarray]:
    """Ids of the texts, each ADDED in them as ADDED_ID."""
    cut = [t.split(ADDED) for t in texts]
    ids = iter(encoder.ids(list(chain.from_iterable(cut))))
    mark = np.array([ADDED_ID], np.uint32)
    return [np.concatenate([x for k in range(len(parts)) for x in ([mark] * (k > 0) + [next(ids)])]) for parts in cut]


@lru_cache(1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One per Python worker, so that later tasks there know the words of earlier ones."""
    return Encoder(path, pattern)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n ids: the first piece takes what does not fill a sequence."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenize(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit).

    Null text is empty: one piece of the end token. Texts of any length are read whole, in parts that no word crosses. Repeated rows have
    pieces each, rows are independent, so there are no ties; an empty table gives an empty result; extra columns, whatever their
    names, are not read; doc_id may be of any type.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)

        def flush(keys: list, texts: list[str], key_type: pa.DataType) -> pa.RecordBatch:
            rows: list[tuple] = []
            for key, ids in zip(keys, with_added(encoder, texts), strict=True):
                whole = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(whole), capacity)):
                    raw = whole[start : start + length].tobytes()
                    rows.append((key, piece, start, length, zlib.crc32(raw), *([raw] if keep_ids else [])))
            kinds = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        for batch in batches:
            keys, texts, n = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key)
                texts.append(text)
                n += len(text)
                if n > CHUNK:
                    yield flush(keys, texts, batch.schema.types[0])
                    keys, texts, n = [], [], 0
            if keys:
                yield flush(keys, texts, batch.schema.types[0])

    return in_batches(docs.select("doc_id", "text"), run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] items of each length: runs of (how many bins, [(length, items of it in each bin), ...])."""
    left = {n: c for n, c in counts.items() if c > 0}
    by_room: dict[int, list[list]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(bins: int, items: list[tuple[int, int]], room: int) -> None:
        if room:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append([bins, items])
        else:
            done.append((bins, items))

    rooms: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            put(left.pop(a), [(a, 1)], capacity - a)
        elif b == a:
            if left[a] > 1:
                put(left[a] // 2, [(a, 2)], capacity - 2 * a)
            if left[a] % 2:
                left[a] = 1
                rest = [x for x in large[:-1] if x <= capacity - a]
                if rest:
                    put(1, [(a, 1), (rest[-1], 1)], capacity - a - rest[-1])
                    left[rest[-1]] -= 1
                    if not left[rest[-1]]:
                        del left[rest[-1]]
                        large.remove(rest[-1])
                else:
                    put(1, [(a, 1)], capacity - a)
            del left[a]
        else:
            n = min(left[a], left[b])
            put(n, [(a, 1), (b, 1)], capacity - a - b)
            left[b] -= n
            if not left[b]:
                del left[b]
                large.remove(b)
            left[a] -= n
            if left[a]:
                continue
            del left[a]
        large.pop(large.index(a))
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if c >= each:
                    put(c // each, [(n, each)], capacity - n * each)
                    c %= each
                else:
                    put(1, [(n, c)], capacity - n * c)
                    c = 0
                continue
            room = rooms[at]
            run = by_room[room][-1]
            each = min(room // n, c)
            bins = min(run[0], c // each)
            run[0] -= bins
            items = run[1]
            if not run[0]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            put(bins, [*items, (n, each)], room - n * each)
            c -= bins * each
    return done + [(bins, items) for runs in by_room.values() for bins, items in runs]


def offsets(sizes: DataFrame, salts: int) -> DataFrame:
    """(length, salt, n) to b_length, b_salt, before: the sum of n over smaller salts of the length, FAN rows at a time."""
    order = lambda *by: W.partitionBy(*by).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    if salts <= FAN:
        return sizes.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("n").over(order("length")), F.lit(0)).alias("before"))
    sizes = sizes.withColumn("above", F.floor(F.col("salt") / FAN))
    upper = offsets(sizes.groupBy("length", F.col("above").alias("salt")).agg(F.sum("n").alias("n")), -(-salts // FAN)).toDF("u_length", "u_salt", "u_before")
    own = sizes.withColumn("own", F.coalesce(F.sum("n").over(order("length", "above")), F.lit(0)))
    both = own.join(upper, (F.col("length") == F.col("u_length")) & (F.col("above") == F.col("u_salt")))
    return both.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), (F.col("own") + F.col("u_before")).alias("before"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with doc_id, piece and length (1 .. capacity).

    The driver sees the histogram (at most `capacity` rows) and sends back the plan (a few rows per length). Ties and repeated
    rows get places of their own: ranks run over (salt, doc_id, piece), and salts are drawn at random and written with the rows, so that equal
    rows spread too. Empty input gives an empty result. Extra columns stay; those with a name that the operator adds are an error.
    """
    reserve(pieces, "sequence_id", "offset", "salt", "r", "p_length", "low", "high", "each", "base", "at", "b_length", "b_salt", "before")
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, seen, base = [], dict.fromkeys(counts, 0), 0
    for bins, items in plan(counts, capacity):
        at = 0
        for length, each in items:
            rows.append((length, seen[length], seen[length] + bins * each, each, base, at))
            seen[length] += bins * each
            at += length * each
        base += bins
    places = spark.createDataFrame(rows, "p_length long, low long, high long, each long, base long, at long")
    salts = max(1, -(-max(counts.values(), default=0) // RANKED))
    salted = materialize(pieces.withColumn("salt", F.floor(F.rand() * salts)), "salted-pieces")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = offsets(materialize(sizes, "salt-sizes"), salts)
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("r", rank).join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt"))).withColumn("r", F.col("r") + F.col("before"))
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))  # a plan has a few rows per length
    slot = F.col("r") - F.col("low")
    return found.select(*pieces.columns, (F.col("base") + F.floor(slot / F.col("each"))).alias("sequence_id"), (F.col("at") + (slot % F.col("each")) * F.col("length")).alias("offset"))


def vocabulary() -> tuple[str, str]:
    """The ranks of byte_bpe_50k (the vocabulary of byte_bpe_50k.json) and its pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens: a row per piece with its place."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return pack(materialize(tokenize(docs, *vocabulary()), "pieces"))
