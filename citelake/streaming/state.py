"""Session messages and the answer cache: batch forms and stateful streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import folded

# Messages kept, seconds a session lives after its last message, seconds a cached answer lives after it was written.
KEEP, SESSION_TTL, CACHE_TTL = 20, 3600, 600


def last_messages(messages: DataFrame, key: str, order: str, keep: int = KEEP) -> DataFrame:
    """The last `keep` rows of each key in order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= keep).drop("back")


def sessions(events: DataFrame, key: str, ts: str, tie: str, ttl: int = SESSION_TTL) -> DataFrame:
    """Adds session, from 0 for each key: a gap of `ttl` seconds or more ends one; each event renews it."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    return events.withColumn("cut_", F.when(gap >= ttl * 1_000_000, 1).otherwise(0)).withColumn("session", F.sum("cut_").over(w).cast("long")).drop("cut_")


def single_turns(requests: DataFrame) -> DataFrame:
    """Requests without a session: only these may be answered from the cache, as other answers depend on what was said before."""
    return requests.filter("session_id is null")


def cache_hits(requests: DataFrame, key: str, ts: str, tie: str, ttl: int = CACHE_TTL) -> DataFrame:
    """Adds hit: a request within `ttl` seconds of the write it finds; hits do not renew it, so requests are folded in order.

    Keys are split at gaps of `ttl` or more, where any entry has expired, so one task has such a run of requests in order, not a key's whole history.
    """
    runs = sessions(requests.withColumn("us_", F.unix_micros(F.col(ts).cast("timestamp"))), key, ts, tie, ttl)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (written,), (us,) = state, row
        hit = written is not None and us - written < ttl * 1_000_000
        return (written if hit else us,), (hit,)

    return folded(runs.select(key, "session", "us_", tie), [key, "session"], ["us_", tie], ["us_"], (None,), step, {"hit": "boolean"}).select(key, tie, "hit")


def session_stream(messages: DataFrame, key: str = "key", keep: int = KEEP, ttl: int = SESSION_TTL) -> DataFrame:
    """(key, n, messages) after each batch with messages of a key: the last `keep` as JSON, by event time. A message `ttl` seconds or more after all before it begins anew; one that comes
    late joins the session that is open and doesn't shorten it. The watermark removes the state of idle keys. messages: key string, ts timestamp, text string.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = state.get if state.exists else ("[]", 0)
        held = json.loads(kept)
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for us, text in zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["text"], strict=True):
            if us - last >= ttl * 1_000_000:
                held = []
            held, last = [*held, text][-keep:], max(last, us)
        state.update((json.dumps(held), last))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]], "n": [len(held)], "messages": [json.dumps(held)]})

    return messages.withWatermark("ts", f"{ttl} seconds").groupBy(key).applyInPandasWithState(step, "key string, n long, messages string", "messages string, last long", "update", GroupStateTimeout.EventTimeTimeout)


def cache_stream(requests: DataFrame, key: str = "key", ttl: int = CACHE_TTL) -> DataFrame:
    """(key, id, hit) of each request, by event time: an entry lives `ttl` seconds from its write, and the watermark removes its state after that. A request that comes late
    finds the entry that is there and doesn't write. requests: key string, id long, ts timestamp.
    Only single turns are cached, see `single_turns`.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (written,) = state.get if state.exists else (None,)
        rows = pd.concat(list(parts)).sort_values(["ts", "id"], kind="stable")
        hits = []
        for us in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            hit = written is not None and us - written < ttl * 1_000_000
            written = written if hit else us
            hits.append(hit)
        state.update((written,))
        state.setTimeoutTimestamp(max(written // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "id": rows["id"].to_numpy(), "hit": hits})

    return requests.withWatermark("ts", f"{ttl} seconds").groupBy(key).applyInPandasWithState(step, "key string, id long, hit boolean", "written long", "append", GroupStateTimeout.EventTimeTimeout)
