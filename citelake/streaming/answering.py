"""The answer use case: cache, gate, model, session and cache again, as one stateful operator.

A single turn belongs to the key of its question and filters, a turn of a session to that session. A key's requests are taken one after the other
as they arrived, so what comes out does not depend on how they were cut into batches. A key's clock is the latest time
that any of its requests had; a request that comes late is answered at that clock and never turns it back. State and output belong to one batch's commit, so both are
written once however often a batch is tried.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKER, cache_digest
from ..operators.boundary import message
from ..operators.cite import NO_EVIDENCE, REMOVED, UNDATED
from .state import CACHE_TTL, KEEP, SESSION_TTL

#: What an answer consists of, and what comes out for a request.
ANSWER = ["outcome", "text", "raw_text", "notes", "cited", "invalid"]
OUT = "key string, id long, hit boolean, messages long, outcome string, text string, raw_text string, notes array<string>, cited array<long>, invalid array<long>"
READS = ["key", "single", "id", "us", "question", "prompt", "top_score", "n_materials", "undated"]


def request_key(filters: tuple[str, ...] = ("country", "doc_type", "publisher")) -> Column:
    return F.when(F.col("session_id").isNull(), F.concat(F.lit("c:"), cache_digest(F.col("question"), *(F.col(c) for c in filters)))).otherwise(F.concat(F.lit("s:"), "session_id"))


class Desk:
    """Answers the requests of a key. model: texts for prompts; it is called for what the cache doesn't have and the gate lets pass."""

    def __init__(self, model: Callable[[list[str]], list[str]], threshold: float, keep: int = KEEP, session_ttl: int = SESSION_TTL, cache_ttl: int = CACHE_TTL):
        import re

        if threshold is None:
            raise ValueError("no threshold is set")
        self.model, self.threshold, self.keep, self.session_us, self.cache_us = model, threshold, keep, session_ttl * 1_000_000, cache_ttl * 1_000_000
        self.marker = re.compile(MARKER)

    def answer(self, row: dict) -> dict:
        n = row["n_materials"] or 0
        if row["top_score"] is None or row["top_score"] < self.threshold:
            return dict(zip(ANSWER, ("refused", NO_EVIDENCE, "", [], [], []), strict=True))
        if not n:
            return dict(zip(ANSWER, ("degraded", NO_EVIDENCE, "", [], [], []), strict=True))
        try:
            (raw,) = self.model([row["prompt"]])
        except MemoryError:
            raise
        except Exception as e:
            return dict(zip(ANSWER, ("failed", None, message(e), [], [], []), strict=True))
        numbers = [x for x in dict.fromkeys(int(x) for x in self.marker.findall(raw)) if x < 1 << 63]
        cited, invalid = sorted(x for x in numbers if 1 <= x <= n), [x for x in numbers if not 1 <= x <= n]
        notes = [UNDATED] if row["undated"] else []
        if not cited:
            return dict(zip(ANSWER, ("degraded", NO_EVIDENCE, raw, notes, [], invalid), strict=True))
        notes += [REMOVED % "、".join(map(str, invalid))] if invalid else []
        return dict(zip(ANSWER, ("normal", raw, raw, notes, cited, invalid), strict=True))

    def take(self, state: dict, row: dict) -> tuple[dict, dict]:
        """(state, output) after a request. state: clock; written and entry, or last and messages. What failed is not kept."""
        clock = max(row["us"], state.get("clock", row["us"]))
        state = state | {"clock": clock}
        if row["single"]:
            if "entry" in state and clock - state["written"] < self.cache_us:
                return state, {"hit": True, "messages": 0, **state["entry"]}
            found = self.answer(row)
            if found["outcome"] != "failed":
                state |= {"written": clock, "entry": found}
            return state, {"hit": False, "messages": 0, **found}
        if clock - state.get("last", clock) >= self.session_us:
            state = {"clock": clock}
        found = self.answer(row)
        if found["outcome"] != "failed":
            held = [*state.get("messages", []), {"role": "user", "content": row["question"]}, {"role": "assistant", "content": found["text"]}]
            state |= {"last": clock, "messages": held[-self.keep :]}
        return state, {"hit": False, "messages": len(state.get("messages", [])), **found}


def prepared(requests: DataFrame) -> DataFrame:
    """`requests` (id, ts, session_id, question, filters, prompt, top_score, n_materials and, if wanted, undated) with key, single and us."""
    undated = F.col("undated") if "undated" in requests.columns else F.lit(False)
    filters = tuple(c for c in ("country", "doc_type", "publisher") if c in requests.columns)
    return requests.withColumns({"key": request_key(filters), "single": F.col("session_id").isNull(), "us": F.unix_micros("ts"), "undated": F.coalesce(undated, F.lit(False))})


def answered(requests: DataFrame, model: Callable[[list[str]], list[str]], threshold: float, keep: int = KEEP, session_ttl: int = SESSION_TTL, cache_ttl: int = CACHE_TTL) -> DataFrame:
    """The answers to all requests of a table: key, id, hit, messages (of the session, after this turn) and the answer.

    id: the order of arrival. outcome: normal, degraded (no valid citation, or no materials), refused (by the gate) or failed (the model raised; raw_text says what). Only normal, degraded and refused
    answers are kept, single turns in the cache, others as two messages of the session. Requests of a key pass through one task as a stream. Null scores are refused; null times are errors.
    """
    desk = Desk(model, threshold, keep, session_ttl, cache_ttl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != last:
                    last, state = row["key"], {}
                state, found = desk.take(state, row)
                out.append({"key": last, "id": row["id"], **found})
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(OUT))
    return prepared(requests).select(READS).repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, OUT)


def replies(desk: Desk, key: str, parts: list[pd.DataFrame], state: dict) -> tuple[pd.DataFrame, dict]:
    """(answers, state) after a key's requests, by id. Columns become lists of plain values: most keys have a few rows, where frames taken by row cost more than the answers."""
    rows = pd.concat(parts) if len(parts) > 1 else parts[0]
    columns = [[None if v != v else v for v in rows[c].tolist()] for c in READS]
    found = []
    for i in rows["id"].to_numpy().argsort(kind="stable").tolist():
        row = {c: values[i] for c, values in zip(READS, columns, strict=True)}
        state, answer = desk.take(state, row | {"us": int(row["us"]), "single": bool(row["single"]), "undated": bool(row["undated"])})
        found.append((key, row["id"], answer["hit"], answer["messages"], *(answer[c] for c in ANSWER)))
    return pd.DataFrame(dict(zip(["key", "id", "hit", "messages", *ANSWER], map(list, zip(*found, strict=True)), strict=True))), state


def answer_stream(requests: DataFrame, model: Callable[[list[str]], list[str]], threshold: float, keep: int = KEEP, session_ttl: int = SESSION_TTL, cache_ttl: int = CACHE_TTL) -> DataFrame:
    """`answered` for a stream of requests, in append mode; batches must come in the order of arrival.

    A key's state goes after two lifetimes without a request, by the machine's clock: by then it has expired unless the stream runs at less than half of the
    requests' own pace. Lifetimes themselves go by the requests' times. Late requests are never dropped. Where a stream is drained with availableNow, set
    spark.sql.streaming.noDataMicroBatches.enabled to false, as such state asks for empty batches without end.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    desk = Desk(model, threshold, keep, session_ttl, cache_ttl)
    idle = 2 * max(session_ttl, cache_ttl) * 1000

    def step(k, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        found, state = replies(desk, k[0], list(parts), state)
        held.update((json.dumps(state),))
        held.setTimeoutDuration(idle)
        yield found

    return prepared(requests).select(READS).groupBy("key").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
