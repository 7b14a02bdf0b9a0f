"""Turns from timed words as they arrive: the same turns as a batch makes, each as soon as it is known to be over."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import segments

OUT = "episode_id {kind}, turn_count long, key string, n_words long, start_time double, end_time double, turn_text string"
COLUMNS = ["pos", "word", "start", "end", "key"]


def turns_of_words(words: DataFrame, late: str = "30 seconds", idle_ms: int = 600_000) -> DataFrame:
    """episode_id, turn_count, key, n_words, start_time, end_time, turn_text: runs of words with one key, in the order of pos.

    words: episode_id, pos, word, start, end, key (who speaks; null joins the run in progress, a leading one the first keyed
    run), ts (when the word was said). On a stream a word waits until the watermark, `late` behind the latest ts, has passed it, so
    words may come in any order within that; what comes later is dropped by Spark. A turn is put out when the next begins, and
    an episode's last one when the watermark is idle_ms behind its last word; idle_ms must be longer than any pause within a
    turn. A word that comes twice counts once. State of an episode is its waiting words and its open turn; an
    episode that is over is forgotten, and counts anew if it goes on.
    """
    if not words.isStreaming:
        once = words.dropDuplicates(["episode_id", "pos"])
        return segments.build_turns(once, "episode_id", ["pos"], "key").select("episode_id", F.col("turn_count").cast("bigint").alias("turn_count"), "key", "n_words", "start_time", "end_time", "turn_text")
    kind = words.schema["episode_id"].dataType.simpleString()
    timed = words.select("episode_id", *COLUMNS, "ts").withWatermark("ts", late)
    run = lambda key, frames, state: _advance(key, frames, state, idle_ms)
    return timed.groupBy("episode_id").applyInPandasWithState(run, OUT.format(kind=kind), "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {"waiting": [], "open": [], "key": None, "n": 0, "last": 0, "done": -1}
    known = {w[1] for w in held["waiting"]}
    for f in frames:
        for ts, pos, word, start, end, who in zip((f["ts"].astype("int64") // _unit(f["ts"])).tolist(), f["pos"].tolist(), f["word"].tolist(), f["start"].tolist(), f["end"].tolist(), f["key"].tolist(), strict=True):
            if pos not in known and pos > held["done"]:
                known.add(pos)
                held["waiting"].append([ts, pos, word, start, end, who if isinstance(who, str) else None])
    now = state.getCurrentWatermarkMs()
    ready = sorted((w for w in held["waiting"] if w[0] <= now), key=lambda w: w[1])
    held["waiting"] = [w for w in held["waiting"] if w[0] > now]
    turns: list[list] = []
    for ts, pos, word, start, end, who in ready:
        if who is not None and held["key"] is not None and who != held["key"]:
            turns.append(_closed(key[0], held))
        held["key"] = who if who is not None else held["key"]
        held["open"].append([word, start, end])
        held["last"], held["done"] = max(held["last"], ts), max(held["done"], pos)
    over = held["last"] + idle_ms
    if held["open"] and not held["waiting"] and now >= over:
        turns.append(_closed(key[0], held))
    if held["open"] or held["waiting"]:
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(now + 1, min(w[0] for w in held["waiting"]) if held["waiting"] else over))
    else:
        state.update((json.dumps(held),))
        if state.hasTimedOut:
            state.remove()
        else:
            state.setTimeoutTimestamp(max(now + 1, over))
    yield pd.DataFrame(turns, columns=["episode_id", "turn_count", "key", "n_words", "start_time", "end_time", "turn_text"])


def _unit(ts: pd.Series) -> int:
    """Ticks of a series of timestamps in a millisecond."""
    return {"s": 1, "ms": 1, "us": 1000, "ns": 1_000_000}[getattr(ts.dtype, "unit", "ns")]


def _closed(episode, held: dict) -> list:
    """The open turn as a row; none is open any more."""
    words = held["open"]
    row = [episode, held["n"], held["key"], len(words), min(w[1] for w in words), max(w[2] for w in words), " ".join(w[0] for w in words)]
    held["open"], held["key"], held["n"] = [], None, held["n"] + 1
    return row
