"""Phrases, runs of n words, that several groups have: digests are packed by buckets, and each bucket is sorted on its own."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_WORD = re.compile("[a-z']+")
#: Odd numbers that a word's place in a phrase multiplies its hash by, for the two halves of a digest.
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words whose hashes a task remembers, about.
KNOWN = 1 << 20
#: Bits of a digest that name its bucket, phrases packed at once, and phrases of a bucket beyond which repeated ones are dropped early.
BITS, PACKED, HELD = 12, 1 << 21, 1 << 22
#: Texts packed at once have numbers of so many bits.
_TEXTS = 18

_U = np.uint64
#: What is shuffled of a digest besides its bucket: 72 bits, as digests do not compress.
_SHORT = np.dtype([("a", "<u8"), ("b", "u1")])
PACKS = "bucket int, digests binary, ids array<long>, counts array<int>"
SETS = "n long, k int, g long, h long, b int, members array<long>"


class _Words(dict):
    """Numbers of words, in the order in which they are first seen, and the two hashes of each."""

    def __init__(self) -> None:
        self.halves = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        for seed, half in enumerate(self.halves):
            half.append(xxhash.xxh64_intdigest(word, seed))
        return found


def _digests(numbers: np.ndarray, sizes: np.ndarray, salts: np.ndarray, n: int, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the phrases of texts with `sizes` words each (n or more), and how many phrases a text has."""
    total = len(numbers) - n + 1
    valid = np.arange(total) + n <= np.repeat(np.cumsum(sizes), sizes)[:total]
    out = np.zeros((int(valid.sum()), 2), _U)
    for j, (step, half) in enumerate(zip(_STEPS, words.halves, strict=True)):
        h = np.array(half, _U)[numbers]
        sums = np.zeros(total, _U)
        for k in range(n):
            sums += h[k : k + total] * _U(pow(step, k + 1, 1 << 64))
        out[:, j] = sums[valid]
    out += np.repeat(salts, sizes - n + 1, axis=0)
    return out ^ (out >> _U(29)), sizes - n + 1


def _packed(digests: np.ndarray, ids: np.ndarray, per_text: np.ndarray) -> pa.RecordBatch:
    """A row per bucket: its digests by group, the groups' ids and how many of the digests each has. Most repeats within a group go."""
    ids, group = np.unique(ids, return_inverse=True)
    group = np.repeat(group.astype(_U), per_text)
    low = 64 - BITS - _TEXTS
    key = ((digests[:, 0] >> _U(64 - BITS)) << _U(64 - BITS)) | (group << _U(low)) | (digests[:, 0] & _U((1 << low) - 1))
    order = np.argsort(key)
    digests, key = digests[order], key[order]
    new = np.append(True, (digests[1:] != digests[:-1]).any(axis=1) | (key[1:] != key[:-1]))
    digests, key = _short(digests[new]), key[new]
    runs = np.flatnonzero(np.append(True, np.diff(key >> _U(low)) != 0))
    buckets = (key[runs] >> _U(64 - BITS)).astype(np.int32)
    rows = np.flatnonzero(np.append(True, np.diff(buckets) != 0))
    ends = np.append(rows, len(runs)).astype(np.int32)
    places = pa.py_buffer((np.append(runs[rows], len(key)) * _SHORT.itemsize).astype(np.int32))
    of_run = ids[((key[runs] >> _U(low)) & _U((1 << _TEXTS) - 1)).astype(np.int64)]
    counts = np.diff(np.append(runs, len(key))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (of_run, counts)]
    return pa.RecordBatch.from_arrays([pa.array(buckets[rows]), pa.Array.from_buffers(pa.binary(), len(rows), [None, places, pa.py_buffer(digests)]), *lists], names=["bucket", "digests", "ids", "counts"])


def _short(digests: np.ndarray) -> np.ndarray:
    out = np.empty(len(digests), _SHORT)
    out["a"] = (digests[:, 0] << _U(BITS)) | (digests[:, 1] & _U((1 << BITS) - 1))
    out["b"] = (digests[:, 1] >> _U(BITS)) & _U(255)
    return out


def _read(raw: pa.Buffer, bucket: int) -> np.ndarray:
    """The digests of a row of PACKS, as far as they were shuffled."""
    a, b = (np.frombuffer(raw, _SHORT)[c].astype(_U) for c in "ab")
    return np.stack([(_U(bucket) << _U(64 - BITS)) | (a >> _U(BITS)), (a & _U((1 << BITS) - 1)) | (b << _U(BITS))], axis=1)


def packed_phrases(texts: DataFrame, n: int) -> DataFrame:
    """(text, id, s1, s2) to PACKS: the phrases of n words of [a-z']+ in the lower-case texts, with the ids that have them.

    A text of fewer words, or null, has no phrases. A digest comes from the words' 64-bit hashes and the salts s1 and s2, so equal
    phrases of equal salts are equal on every machine; others are with a chance of 2^-84.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        numbers: list[np.ndarray] = []
        texts: list[tuple[int, int, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            of = np.array(texts, np.int64)
            digests, per_text = _digests(np.concatenate(numbers), of[:, 0], of[:, 2:].view(_U), n, words)
            numbers.clear()
            texts.clear()
            return _packed(digests, of[:, 1], per_text)

        for b in batches:
            for text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = _WORD.findall(text.lower()) if text else []
                if len(found) < n:
                    continue
                numbers.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                texts.append((len(found), *rest))
                held += len(found)
                if held >= PACKED or len(texts) >> _TEXTS:
                    yield flush()
                    held = 0
                    if len(words) > KNOWN:
                        words = _Words()
        if texts:
            yield flush()

    return texts.mapInArrow(run, PACKS)


def _distinct(digests: np.ndarray, ids: np.ndarray, shared: bool) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of digest and id; of digests that stand alone none if only shared ones are asked for."""
    order = np.argsort(digests[:, 0])
    same = np.diff(digests[order, 0]) == 0
    met = np.append(False, same) | np.append(same, False)
    some = order[met]
    some = some[np.lexsort((ids[some], digests[some, 1], digests[some, 0]))]
    new = np.append(True, (digests[some[1:]] != digests[some[:-1]]).any(axis=1) | (ids[some[1:]] != ids[some[:-1]]))[: len(some)]
    keep = some[new] if shared else np.append(some[new], order[~met])
    return digests[keep], ids[keep]


def _sets(digests: np.ndarray, ids: np.ndarray, most: int) -> pa.RecordBatch:
    """SETS of the digests that two ids or more have."""
    digests, ids = _distinct(digests, ids, True)
    starts = np.flatnonzero(np.append(True, (digests[1:] != digests[:-1]).any(axis=1))[: len(ids)])
    size = np.diff(np.append(starts, len(ids)))
    mixed = ids.view(_U) * _U(_STEPS[0])
    mixed = (mixed ^ (mixed >> _U(32))) * _U(_STEPS[1])
    mixed ^= mixed >> _U(29)
    few = np.flatnonzero((size > 1) & (size <= most))
    names = np.add.reduceat(mixed, starts)[few] ^ size[few].astype(_U) if len(few) else np.zeros(0, _U)
    _, first, n = np.unique(names, return_index=True, return_counts=True)  # phrases of the same ids are one row
    first = few[first]
    phrase = np.repeat(np.arange(len(size)), size)
    k = -(-size // most)
    hot = np.flatnonzero((size > most)[phrase])
    block = (mixed[hot] % k[phrase[hot]].astype(_U)).astype(np.int32)
    order = np.lexsort((ids[hot], block, phrase[hot]))
    hot, block = hot[order], block[order]
    cut = np.flatnonzero(np.append(True, (np.diff(phrase[hot]) != 0) | (np.diff(block) != 0))[: len(hot)])
    of = phrase[hot[cut]]
    members = np.concatenate([*(np.arange(starts[i], starts[i] + size[i]) for i in first), hot]).astype(np.int64)
    lengths = np.concatenate([size[first], np.diff(np.append(cut, len(hot)))])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids[members]))
    halves = [pa.array(np.concatenate([np.zeros(len(first), np.int64), digests[starts[of], j].view(np.int64)])) for j in (0, 1)]
    columns = [np.concatenate([n, np.ones(len(of), np.int64)]), np.concatenate([np.ones(len(first)), k[of]]).astype(np.int32), *halves, np.concatenate([np.zeros(len(first)), block[cut]]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns), lists], names=["n", "k", "g", "h", "b", "members"])


def shared_phrases(texts: DataFrame, n: int, most: int) -> DataFrame:
    """(text, id, s1, s2) to SETS: the sorted ids of each phrase that two ids or more have (see packed_phrases).

    Phrases of the same ids are counted in n, bucket by bucket. A phrase of more than `most` ids is dealt to k blocks of about so many: a
    row per block b, with the phrase's digest (g, h). A task holds one bucket, once for each different id of a phrase.
    """
    packs = packed_phrases(texts, n)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        now, held, limit = None, 0, HELD
        for b in batches:
            counts, each = b.column(3), b.column(2)
            for i, (bucket, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                if bucket != now and digests:
                    yield _sets(np.concatenate(digests), np.concatenate(ids), most)
                    digests, ids, held, limit = [], [], 0, HELD
                now = bucket
                digests.append(_read(raw.as_buffer(), bucket))
                ids.append(np.repeat(each[i].values.to_numpy(), counts[i].values.to_numpy()))
                held += len(ids[-1])
                if held > limit:
                    merged, who = _distinct(np.concatenate(digests), np.concatenate(ids), False)
                    digests, ids, held = [merged], [who], len(who)
                    limit = max(HELD, 2 * held)
        if digests:
            yield _sets(np.concatenate(digests), np.concatenate(ids), most)

    return packs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SETS)
