"""Record validation (P1-P8) and unrolling / format detection."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import unroll, validate

MERGED = ("id string, text string, summary string, "
          "schema struct<table_id:string,columns:array<struct<name:string>>>, "
          "table struct<table_id:string,columns:array<struct<name:string>>,data:array<array<string>>>")


def _merged(spark):
    rows = [
        ("a", "Some text.", None, ("t", [("x",), ("y",)]), ("t", [("y",), ("x",)], [["1", "2"]])),
        ("", "  ", "", ("t", [("x",)]), ("u", [("y",)], [])),
        ("c", "text", "sum", (None, [("x",), ("z",)]), (None, [("x",)], None)),
    ]
    return spark.createDataFrame(rows, MERGED)


def test_violations(spark):
    got = {r["id"]: r["violations"] for r in validate.with_violations(_merged(spark)).collect()}
    assert got["a"] == []
    assert got[""] == ["missing non-empty 'id'", "missing/empty 'text'", "schema.table_id != table.table_id",
                       "table missing schema columns: x"]
    assert got["c"] == ["table missing schema columns: z"]       # null table ids are equal
    with pytest.raises(validate.ValidationError, match="id=: missing non-empty"):
        validate.raise_on_violations(validate.with_violations(_merged(spark)))


def test_fallback_nonempty_and_usable(spark):
    df = _merged(spark)
    r = {x["id"]: x for x in df.select("id", validate.text_with_fallback().alias("t"),
                                       validate.nonempty_table().alias("ne")).collect()}
    assert (r["a"]["t"], r[""]["t"], r["c"]["t"]) == ("Some text.", "  ", "sum")
    assert (r["a"]["ne"], r[""]["ne"], r["c"]["ne"]) == (True, False, False)
    assert [x["id"] for x in validate.usable_for_schema_stage(df).collect()] == ["a", "c"]


def test_json_field_types(spark):
    df = spark.createDataFrame([('{"s": ["a"], "t": "x"}',), ('{"s": "a", "t": 1}',), ('{"t": "x"}',)], "raw string")
    got = [r["v"] for r in df.select(validate.json_field_types("raw", {"s": "array", "t": "string"}).alias("v")).collect()]
    assert got == [[], ["'s' is not a array", "'t' is not a string"], ["'s' is not a array"]]


def test_unroll_with_and_without_key(spark):
    rows = spark.createDataFrame([
        ("t1", 0, ["name", "city", "n"], ["Ann", "Oslo", "1"]),
        ("t1", 1, ["name", "city", "n"], ["Bob", "N/A", "1"]),
        ("t2", 0, ["a", "b"], ["x", "y"]),
        ("t2", 1, ["a", "b"], ["x", "y"]),
        ("t2", 2, ["a", "b"], ["z"]),                      # short row: missing cell
    ], "t string, row_pos long, headers array<string>, values array<string>")
    out = unroll.unroll_rows(rows, ["t"]).orderBy("t", "row_pos", "col_pos").collect()
    got = [(r["t"], r["statement"]) for r in out]
    assert got == [("t1", "The city of Ann is Oslo."), ("t1", "The n of Ann is 1."), ("t1", "The n of Bob is 1."),
                   ("t2", "The a of row 1 is x."), ("t2", "The b of row 1 is y."),
                   ("t2", "The a of row 2 is x."), ("t2", "The b of row 2 is y."), ("t2", "The a of row 3 is z.")]


def test_table_format_and_names(spark):
    recs = spark.createDataFrame([(3, '{"columns": [], "data": []}'), (2, '{"T": {"headers": ["a"], "rows": []}}'),
                                  (1, '{"x": 1}'), (4, "not json")], "k long, t string")
    r = unroll.dataset_format(recs, "k", "t").first()
    assert (r["format"], r["n_pivot"], r["n_multi"], r["n_unknown"]) == ("multi", 1, 1, 2)
    tables = spark.createDataFrame([(1, "B", ["h"]), (1, "A", ["h"]), (2, "A", []), (2, "C", ["h"])],
                                   "id long, table_name string, headers array<string>")
    rows = spark.createDataFrame([(1, "B", 0), (1, "A", 0), (2, "A", 0)], "id long, table_name string, row_pos long")
    assert [r["table_name"] for r in unroll.usable_table_names(tables, rows).collect()] == ["A", "B"]


def test_split_statements(spark):
    df = spark.createDataFrame([("One. Two!  Three?\nOne.\n\nfour e.g.x",)], "t string")
    assert df.select(unroll.split_statements("t").alias("s")).first()["s"] == ["One.", "Two!", "Three?", "four e.g.x"]


def test_named_tables_make_their_names_before_cells_are_exploded(spark):
    cell = lambda v: ("str", v, None)
    tables = spark.createDataFrame([("1", "Line Items", ["k", "v"]), ("1", "team", ["a"]), ("2", "Line Items", [])],
                                   "id string, table_name string, headers array<string>")
    rows = spark.createDataFrame([("1", "Line Items", 0, [cell("x"), cell("1")]), ("1", "Line Items", 1, [cell("y"), None]),
                                  ("1", "team", 0, [cell("z")]), ("2", "Line Items", 0, [cell("w")])],
                                 "id string, table_name string, row_pos long, cells array<struct<kind:string,s:string,i:bigint>>")
    out = unroll.unroll_named_tables(tables, rows)
    got = sorted((r["id"], r["category"], r["display_name"], r["statement"]) for r in out.collect())
    assert got == [("1", "line_items", "Line Items", "The v of x is 1.")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" in plan[plan.index("Generate"):] and "initcap" not in plan[:plan.index("Generate")]
