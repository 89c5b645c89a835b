"""The answer stream: any number of micro-batches gives what the batch form gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citelake.plans.answers import echo
from citelake.streaming import answering

SCHEMA = "id long, ts timestamp, session_id string, question string, country string, prompt string, top_score double, n_materials long"


def requests(spark):
    r, at, rows = random.Random(2), 1_700_000_000, []
    for i in range(200):
        at += r.choice([1, 30, 200, 700, 2500])
        late = at - r.choice([0, 0, 0, 400, 5000, 90_000])  # some come late, a few by a day
        rows.append((i, late, r.choice([None, None, "s1", "s2"]), f"q{r.randint(0, 4)}", r.choice([None, "DE"]), f"{r.randint(0, 5)}" + r.choice(["", " [1]", " [9][2]"]), r.choice([None, 0.1, 0.9, 0.9]), r.choice([0, 3, 3])))
    d = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "us long"))
    return d.withColumn("ts", F.timestamp_seconds("us")).select([c.split()[0] for c in SCHEMA.split(", ")])


def result(df):
    return Counter((x.id, x.key, x.hit, x.messages, x.outcome, x.text, x.raw_text, tuple(x.notes), tuple(x.cited), tuple(x.invalid)) for x in df.collect())


@pytest.mark.parametrize("batches", (1, 3, 12))
def test_any_number_of_batches(spark, tmp_path, batches):
    d = requests(spark)
    for b in range(batches):
        d.filter(F.floor(F.col("id") * batches / 200) == b).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        out = answering.answer_stream(stream, echo, 0.5)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    want = result(answering.answered(d, echo, 0.5))
    assert result(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) == 200
    assert {x[4] for x in want} == {"normal", "degraded", "refused", "failed"} and any(x[2] for x in want)


def test_a_late_request_does_not_turn_the_clock_back():
    desk = answering.Desk(lambda prompts: [f"{p} [1]" for p in prompts], 0.5)
    row = lambda s, single=True: {"single": single, "us": s * 1_000_000, "question": "q", "prompt": "p", "top_score": 0.9, "n_materials": 1, "undated": False}
    state, hits = {}, []
    for s in (0, -500, 500, 600):  # written at 0, so gone at 600
        state, found = desk.take(state, row(s))
        hits.append(found["hit"])
    assert hits == [False, True, True, False]
    state, kept = {}, []
    for s in (0, 3000, -9000, 6500, 10100):
        state, found = desk.take(state, row(s, False))
        kept.append(found["messages"])
    assert kept == [2, 4, 6, 8, 2]
    with pytest.raises(ValueError, match="threshold"):
        answering.Desk(lambda p: p, None)


def test_a_keys_requests_are_not_taken_as_frames(monkeypatch):
    import pandas as pd

    def part(ids):
        n = len(ids)
        return pd.DataFrame({"key": "s:a", "single": False, "id": ids, "us": [i * 1_000_000 for i in ids], "question": [f"q{i}" for i in ids], "prompt": [f"{i} [1]" for i in ids], "top_score": [None if i == 3 else 0.9 for i in ids], "n_materials": [None if i == 2 else 3 for i in ids], "undated": [True] * n})

    for name in ("where", "to_dict", "iterrows", "itertuples"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    desk = answering.Desk(echo, 0.3)
    got, held = answering.replies(desk, "s:a", [part([5, 2]), part([3, 1])], {})
    assert got[["key", "id", "messages", "outcome"]].values.tolist() == [["s:a", 1, 2, "normal"], ["s:a", 2, 4, "degraded"], ["s:a", 3, 6, "refused"], ["s:a", 5, 8, "normal"]]
    assert got["text"].tolist()[::3] == ["1 [1]", "5 [1]"]
    monkeypatch.setattr(pd, "concat", None)  # one part needs none
    again, _ = answering.replies(desk, "s:a", [part([7])], held)
    assert again["messages"].tolist() == [10]
