"""Chat rows, buckets and step plans."""

import math

from pyspark.sql import functions as F

from tabwright.operators import chat


def test_metadata_injection_and_null_content(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (2, 0, "system", "s"), (2, 1, " ", "dropped"),
                                   (2, 2, "user", "u")], "k long, t long, role string, text string")
    md = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 2}')], "k long, metadata string")
    m = {r["k"]: r for r in chat.messages_from_turns(turns, "k", "t", metadata=md).collect()}
    msgs = [(x["role"], x["content"]) for x in m[1]["messages"]]
    assert msgs == [("system", '[METADATA]\n{"k": 1}'), ("user", "None")]
    assert m[1]["char_len"] == len('[METADATA]\n{"k": 1}') + 4
    assert [x["role"] for x in m[2]["messages"]] == ["system", "user"]   # first turn is system: no injection
    lens = {r["k"]: r for r in chat.conversation_lengths(turns, "k", "t", metadata=md).collect()}
    assert lens[1]["char_len"] == m[1]["char_len"] and lens[2]["char_len"] == m[2]["char_len"]


def test_length_stages(spark):
    df = spark.createDataFrame([(n,) for n in (4095, 4096, 8191, 8192)], "char_len long")
    assert [r["stage"] for r in chat.with_length_stage(df).collect()] == [1, 2, 2, 3]


def test_step_plan(spark):
    staged = spark.range(1000).select(F.lit(1).alias("stage"))
    counts = chat.stage_counts(staged)
    plan = {r["stage"]: r for r in chat.step_plan(counts, chat.StagePlanConfig(devices=2)).collect()}
    s1, s2 = plan[1], plan[2]
    assert (s1["global_batch"], s1["steps_per_epoch"], s1["target_steps"], s1["epochs"], s1["total_steps"]) == (64, 16, 640, 40, 640)
    assert (s2["steps_per_epoch"], s2["target_steps"], s2["epochs"], s2["total_steps"]) == (16, 804, 51, 816)
    assert s2["n_rows"] == 0 and s2["effective_rows"] == 1000    # empty bucket falls back to the full set
    capped = chat.step_plan(counts, chat.StagePlanConfig(devices=2, max_steps=200)).filter("stage = 1").first()
    assert (capped["total_steps"], capped["epochs"], capped["max_samples"]) == (200, 1, 12800)
    assert math.ceil(1000 / 64) == 16


def test_flatten(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "k long, t long, role string, text string")
    m = chat.messages_from_turns(turns, "k", "t")
    r = m.select(chat.flatten_chat("messages").alias("a"), chat.flatten_chat("messages", prompt=True).alias("b")).first()
    assert r["a"] == "user: hi\nassistant: yo" and r["b"] == "user: hi\nassistant: yo\nassistant: "


def test_chat_rows_from_jsonl_lines(spark):
    import json
    lines = [
        json.dumps({"messages": [{"role": "user", "content": None}], "metadata": {"k": 1}}),
        json.dumps({"messages": [], "conversations": [{"role": "system", "content": "s"}, "junk",
                                                      {"role": " ", "content": "x"},
                                                      {"role": "user", "content": ["a", {"b": 1}]}],
                    "metadata": "plain"}),
        json.dumps({"messages": [{"content": "no role"}]}),
        "not json", "", json.dumps({"messages": "not a list"}),
    ]
    df = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "i long, line string")
    got = {r["i"]: r for r in chat.chat_rows_from_lines(df, keep=["i"]).collect()}
    assert sorted(got) == [0, 1]
    assert [(m["role"], m["content"]) for m in got[0]["messages"]] == [("system", '[METADATA]\n{"k": 1}'),
                                                                       ("user", "None")]
    assert got[0]["char_len"] == len('[METADATA]\n{"k": 1}') + 4
    assert [(m["role"], m["content"]) for m in got[1]["messages"]] == [("system", "s"),
                                                                       ("user", '["a", {"b": 1}]')]
