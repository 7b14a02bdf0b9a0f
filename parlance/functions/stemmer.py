"""Word stems after M. F. Porter, "An algorithm for suffix stripping" (1980), for tables of distinct terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_VOWELS = frozenset("aeiou")
_DOUBLE = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_TRIPLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """v or c per letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in _VOWELS or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case English word; words of two letters, and any that are not ASCII letters, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_DOUBLE, _TRIPLE):
        for end, new in table:
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) else w
                break
    for end in sorted(_LAST, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def with_stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(column) to (column, stem); meant for the distinct terms of a corpus, which are few beside its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w and stem(w) for w in words], pa.string())], names=[column, "stem"])

    return terms.select(column).mapInArrow(run, f"{column} string, stem string")
