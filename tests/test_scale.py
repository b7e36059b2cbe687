"""Steps whose cost per row must not grow with how often their result is used (round 3), on rows of their own."""

import json
import random

from pyspark.sql import functions as F

from tabwright.functions import constants as K
from tabwright.functions import strict_json as SJ
from tabwright.functions import text as T
from tabwright.operators import evaluate as EV
from tabwright.operators import extract, messages


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_schema_fields_decode_each_text_once(spark):
    block = json.dumps({"A": {"column_headers": ["x", "points"]}, "B": {"col_headers": ["x"]}})
    df = spark.createDataFrame([(1, f"{K.FINAL_SCHEMA_MARKER}\n{block}"), (2, None)], "id int, raw string")
    _, fields = extract.parse_schema_outputs(df, "id", "raw")
    plan = _plan(fields)
    assert plan.count("json_values(") == 2 and plan.count("try_parse_json") + plan.count("parseJson") <= 1
    assert sorted((r["name"], r["type"], r["required"], r["schema_id"]) for r in fields.collect()) == [
        ("a_name", "string", True, "a_b_schema"), ("b_name", "string", False, "a_b_schema"),
        ("points", "integer", False, "a_b_schema"), ("x", "integer", False, "a_b_schema")]


def test_rendered_rows_look_up_each_column_once(spark):
    df = spark.createDataFrame([(["b", "a", "z"], ["a", "b", "a"], [["1", ' "2" ', None], ["3"], [], None])],
                               "sn array<string>, tn array<string>, rows array<array<string>>")
    out = df.select(messages.render_ndjson("sn", "tn", "rows").alias("t"))
    assert _plan(out, "analyzed").count("array_position(") <= 2
    assert out.first()["t"].split("\n") == ['{"b": "\\"2\\"", "a": "", "z": ""}', *['{"b": "", "a": "", "z": ""}'] * 3]


def test_failures_are_dealt_before_the_range_sort(spark):
    flags = spark.createDataFrame([(2, False, False, False), (1, True, False, False), (3, True, True, True)],
                                  "k int, json_ok boolean, keys_ok boolean, types_ok boolean")
    out = EV.sanity_failures(flags, "k")
    assert "REPARTITION_BY_COL" in _plan(out, "executedPlan")
    assert [tuple(r) for r in out.collect()] == [(1, "key_order_mismatch"), (1, "type_mismatch"), (2, "json_parse_error")]


def test_tables_are_parsed_without_sorting_lines(spark):
    mark = K.FINAL_TABLES_MARKER
    raw = f"x | y\n{mark}\n| lost |\n### A\n| h | g |\n| 1 || +02 |\ntext\n###  \n| no name |\n### B\n|b|\n### A\n| k |\n| null |\n### C\n"
    rows = [(1, raw), (2, None), (3, "no section | here"), (4, mark + "\n### C\n"), (5, ""),
            (6, f"{mark}\n### T\n|a|\n|1|"), (6, f"{mark}\n### T\n|a|\n|1|")]
    long = extract.parse_markdown_tables_long(spark.createDataFrame(rows, "id int, raw string"), "id", "raw", with_rejects=True)
    assert "Window" not in _plan(long) and "Sort [" not in _plan(long)
    got = [(r["id"], r["table_pos"], r["table_name"], r["kind"], r["row_pos"], r["headers"],
            r["cells"] and [c and (c["s"], c["i"]) for c in r["cells"]], r["reason"]) for r in long.collect()]
    twice = [(6, 0, "T", "header", None, ["a"], None, None)] * 2 + [
        (6, 0, "T", "row", i, None, [(None, 1)], None) for i in (1, 2)]      # one text of doubled lines
    want = [(1, 0, "A", "header", None, ["k"], None, None), (1, 0, "A", "row", 0, None, [None], None),
            (1, 1, "B", "header", None, ["b"], None, None),
            (2, None, None, "reject", None, None, None, extract.NO_OUTPUT), (3, None, None, "reject", None, None, None, extract.NO_TABLES),
            (4, None, None, "reject", None, None, None, extract.NO_TABLE), (5, None, None, "reject", None, None, None, extract.NO_TABLES)]
    assert sorted(got, key=repr) == sorted(want + twice, key=repr)


def test_lines_are_those_of_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "\n", "\n", " ", rng.choice("\r\v\f\x1c\x1d\x1e\x1f\x85  \t\x0e")])
                     for _ in range(rng.randrange(7))) for _ in range(600)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.py_lines("t").alias("ls")).collect()
    assert all(r["ls"] == r["t"].splitlines() for r in got)
    assert "\\n, -1" in _plan(spark.createDataFrame([("",)], "t string").select(T.py_lines("t"))).replace("\n", "\\n")


def test_json_line_verdicts(spark):
    lines = ['{"b": 1.50, "a": null, "b": true}', "[1]", "{", '{"n": {"x": [1, "é"]}, "s": ""}', "{}", "NaN", None]
    df = spark.createDataFrame([(1, lines[:3]), (2, None), (3, []), (4, lines[3:])], "id int, ls array<string>").coalesce(1)
    got = {r["id"]: r["v"] and [tuple(x) for x in r["v"]] for r in df.select("id", SJ.parse_json_lines("ls").alias("v")).collect()}
    assert got[1] == [(True, True, ["b", "a"], ["True", None]), (True, False, None, None), (False, False, None, None)]
    assert got[2] is None and got[3] == []
    assert got[4] == [(True, True, ["n", "s"], ["{'x': [1, 'é']}", ""]), (True, True, [], []), (True, False, None, None),
                      (False, False, None, None)]


def test_table_names_make_no_cell_text(spark):
    from tabwright.operators import json_tables
    lines = ['{"tables": {"A": {"headers": ["x"], "rows": [[1]]}, "B": {"headers": [], "rows": [[1]]}, "C": 3}}',
             '{"tables": {"D": {"headers": ["x"], "rows": []}, "E": {"headers": [null], "rows": [null]}}}', '{"tables": null}', "{}"]
    rec = spark.createDataFrame([(x,) for x in lines], "line string").select(F.parse_json("line").alias("record"))
    names = json_tables.table_names(rec)
    assert "schema_of_variant" not in _plan(names).lower() and "schemaOfVariant" not in _plan(names)
    assert [r["table_name"] for r in names.collect()] == ["A", "E"]
