"""Tables inside JSON records: adapters, keys and sentences within the record."""

import json

from pyspark.sql import functions as F

from tabwright.operators import json_tables as J
from tabwright.sources import jsonl


def records(spark, rows):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i long, line string")
    return jsonl.with_records(lines)


def test_pivot_tables_and_sentences(spark):
    rows = [{"id": 1, "table": {"columns": [{"name": "a"}, {"name": "b"}, {}], "data": [["x", 1, True], ["y", None, 2.0], ["z"]]}},
            {"id": 2, "table": None}, {"id": 3}, {"id": 4, "table": {"columns": [], "data": [[1]]}},
            {"id": 5, "table": {"columns": [{"name": "a"}], "data": []}}, {"id": 6, "table": [1]}, {"id": 7, "table": "text"},
            {"id": 8, "table": {"columns": [{"name": "k"}, {"name": "v"}], "data": [["x", 1], ["x", 1.5]]}},
            {"id": 9, "table": {"columns": [{"name": "k"}, {"name": "v"}], "data": [["x", 1], ["x", " n/a "]]}}]
    t = J.with_statements(J.pivot_tables(records(spark, rows)))
    got = {r["i"]: r for r in t.collect()}
    assert sorted(got) == [0, 7, 8]
    assert got[0]["rows"] == [["x", "1", "True"], ["y", None, "2.0"], ["z"]]
    assert [tuple(s) for s in got[0]["statements"]] == [
        (0, 1, "The b of x is 1."), (0, 2, "The  of x is True."), (1, 2, "The  of y is 2.0.")]
    assert [s["statement"] for s in got[7]["statements"]] == ["The k of 1 is x.", "The k of 1.5 is x."]
    assert [s["statement"] for s in got[8]["statements"]] == ["The k of row 1 is x.", "The v of row 1 is 1.", "The k of row 2 is x."]


def test_named_tables_names_and_kinds(spark):
    rows = [{"tables": {"Big One": {"headers": ["a", "b"], "rows": [["x", 1]]}, "none": None, "bad": {"headers": ["a"]}}},
            {"tables": {"empty": {"headers": ["a"], "rows": []}, "Big One": {"headers": ["c"], "rows": [[3]]}}},
            {"tables": {"columns": [], "data": []}}, {"tables": 3}, {"tables": {"x": 1}}]
    rec = records(spark, rows)
    got = sorted((r["i"], r["table_name"], r["category"], r["headers"], r["rows"]) for r in J.named_tables(rec).collect())
    assert got == [(0, "Big One", "big_one", ["a", "b"], [["x", "1"]]), (1, "Big One", "big_one", ["c"], [["3"]])]
    assert [r["table_name"] for r in J.table_names(rec).collect()] == ["Big One"]
    kinds = {r["i"]: r["format"] for r in J.table_kind(rec, "tables").collect()}
    assert kinds == {0: "multi", 1: "multi", 2: "pivot", 3: None, 4: None}


def test_unroll_needs_no_shuffle(spark):
    t = J.with_statements(J.pivot_tables(records(spark, [{"table": {"columns": [{"name": "a"}], "data": [[1]]}}])))
    plan = t.select(F.size("statements"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
