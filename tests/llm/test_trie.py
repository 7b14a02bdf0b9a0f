"""The conversation trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from parlance.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows, stems=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if stems else 0
        base = c - c % 100 if c >= 0 else c + -c % 100
        whole[c] = own.get(base, [])[:h] + s[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    text = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(text(k).encode()).hexdigest()) for k, m in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(95, 130), -150, -100, -7, 250, 300]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None, ""]), rng.choice(["ä", "bb", "ccc\n", "", None])))
    rows += [(7, 3, "user", "again")] * 3 + [(None, 1, "user", "nobody's")]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"p": F.lit(1), "depth": F.lit("x"), "place": F.lit(0)})
    assert rows_of(trie.trie(trie.with_stems(trie.turns(df)))) == brute(rows)


def test_deep_path_of_ends_and_equal_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(c % 20 + 1)] + [(1000, t, "user", f"t{t}") for t in range(300)]
    assert rows_of(trie.trie(trie.turns(spark.createDataFrame(rows, COLUMNS)))) == brute(rows, stems=False)


def test_roles_and_texts_are_kept_apart_and_empty_tables(spark):
    rows = [(0, 0, "a", "bc"), (1, 0, "ab", "c"), (2, 0, "", "abc")]
    out = rows_of(trie.trie(trie.turns(spark.createDataFrame(rows, COLUMNS))))
    assert out == brute(rows, stems=False) and len(out) == 4
    assert trie.trie(trie.with_stems(trie.turns(spark.createDataFrame([], COLUMNS)))).isEmpty()


def test_conversations_without_turns_end_at_the_root(spark):
    lost = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 1)  # its hundred has no stem
    rows = [(lost, 0, "user", "gone"), (5, 0, "user", "x")]
    out = rows_of(trie.trie(trie.with_stems(trie.turns(spark.createDataFrame(rows, COLUMNS)))))
    assert out == brute(rows) and hashlib.sha256(str(lost).encode()).hexdigest() in {r[-1] for r in out if r[1] == 0} or hashlib.sha256(f"5,{lost}".encode()).hexdigest() == out[0][-1]


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(trie.op11_trie(spark, d)) == brute(rows)
