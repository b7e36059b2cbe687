"""Extraction jobs (X1-X7) on hand-made model outputs, plus round trips."""

import json

from pyspark.sql import functions as F

from tabwright.functions import text as T
from tabwright.operators import extract, messages


def _one(df, col):
    return df.first()[col]


def test_atomic_no_marker(spark):
    df = spark.createDataFrame([(" a \n\n b\n",)], "raw string")
    assert _one(extract.with_atomic_statements(df, "raw", "s"), "s") == ["a", "b"]


def test_atomic_marker_and_stop(spark):
    raw = "<REASONING STEPS>\nthink\n### Atomic Statements:\n  s1 \n\ns2\n*** end\ns3"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert _one(extract.with_atomic_statements(df, "raw", "s"), "s") == ["s1", "s2"]


def test_numbered_statements(spark):
    texts = ["Table:\n|x|\n\nStatements:\n1. a\n  2. indented\nno number\n3.   c  \n\nRows:\n1. |x|",
             "Statements:\n\n1. x",
             "Statements:\n1. a\nRows:\n2. b",
             None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in extract.with_numbered_statements(df, "t", "s").collect()]
    assert got == [["a", "c"], [], ["a"], []]


def test_numbered_round_trip(spark):
    st = ["The team won.", "12. starts with a number", "Rows: inside"]
    df = spark.createDataFrame([(st,)], "st array<string>")
    raw = F.concat(F.lit("Statements:\n"), T.number_lines("st"), F.lit("\n\nRows:\n"))
    assert _one(extract.with_numbered_statements(df.select(raw.alias("raw")), "raw", "s"), "s") == st


SCHEMA_OUT = """Reasoning first.
### Final Schema:
{
  "Team": {"row_headers": ["Suns"], "column_headers": ["Team", "Wins", "Total Points"]}
  "Player": {"row_headers": [], "col_headers": ["Player", "Points", "Wins"]}
}
trailing text"""


def test_schema_block_repair(spark):
    df = spark.createDataFrame([(1, SCHEMA_OUT), (2, 'x\n{"schema": {"schema_id": "s",\n "fields": []}}'), (3, "none")],
                               "k long, raw string")
    explicit, fields = extract.parse_schema_outputs(df, "k", "raw")
    assert [(r["k"], json.loads(r["schema_json"])["schema"]["schema_id"]) for r in explicit.collect()] == [(2, "s")]
    f = fields.orderBy("grp", "p1", "p2").collect()
    assert [(r["name"], r["type"], r["required"]) for r in f] == [
        ("team_name", "string", True), ("player_name", "string", False), ("team", "string", False),
        ("wins", "integer", False), ("total_points", "integer", False), ("player", "string", False),
        ("points", "integer", False)]
    assert {r["schema_id"] for r in f} == {"team_player_schema"}


TABLE_OUT = """steps...
### Final Output Tables:

### Team
| Team | Wins | Losses | Total Points |
|---|---|---|---|
| Thunder | 16 | 17| None |
| Suns | 18 | None | 134 |

### Player:
| Player | Points | Minutes Played |
| Kevin Durant | 44 | 40 |
|a| |3|

### Team
| Team | Wins |
| Heat | 1_000 |
"""


def test_markdown_tables(spark):
    df = spark.createDataFrame([(1, TABLE_OUT)], "k long, raw string")
    tables, rows = extract.parse_markdown_tables(df, "k", "raw")
    t = {r["table_name"]: r for r in tables.collect()}
    assert t["Team"]["table_pos"] == 0 and t["Team"]["headers"] == ["Team", "Wins"]   # later one wins, first position
    assert t["Player:"]["table_pos"] == 1
    rr = rows.orderBy("table_name", "row_pos").collect()
    cells = [(r["table_name"], [None if c is None else (c["i"] if c["kind"] == "int" else c["s"]) for c in r["cells"]])
             for r in rr]
    assert cells == [("Player:", ["Kevin Durant", 44, 40]), ("Player:", ["a", 3]), ("Team", ["Heat", "1_000"])]


def test_markdown_separator_line_is_a_row(spark):
    df = spark.createDataFrame([(1, "### Final Output Tables\n### T\n|a|b|\n|---|---|\n|1|2|")], "k long, raw string")
    _, rows = extract.parse_markdown_tables(df, "k", "raw")
    assert rows.count() == 2


def test_markdown_round_trip(spark):
    heads, data = ["c1", "c2"], [["x", "5"], ["y z", None]]
    df = spark.createDataFrame([(1, heads, data)], "k long, h array<string>, d array<array<string>>")
    md = messages.table_to_markdown(F.col("h"), F.col("d"))
    raw = df.select("k", F.concat(F.lit("### Final Output Tables:\n### Tab\n"), md).alias("raw"))
    tables, rows = extract.parse_markdown_tables(raw, "k", "raw")
    assert tables.first()["headers"] == heads
    got = [[T_cell(c) for c in r["cells"]] for r in rows.orderBy("row_pos").collect()]
    assert got == [["x", 5], ["y z", None]]


def T_cell(c):
    return None if c is None else (c["i"] if c["kind"] == "int" else c["s"])


def test_schema_from_user_turn_and_ndjson(spark):
    user = 'p\n\n[SCHEMA]\n{"schema_id": "t", "fields": [{"name": "a", "type": "integer"}]}\n\n<|document|>\n\n[DOCUMENT]\nx'
    df = spark.createDataFrame([([("system", "s"), ("user", user)], '{"a": 1}\n\n{"a": "x"}\nnot json')],
                               "m array<struct<role:string,content:string>>, g string")
    r = df.select(extract.schema_from_user_turn(extract.first_user_turn("m")).alias("s"),
                  extract.ndjson_rows("g").alias("v")).first()
    assert [(f["name"], f["type"]) for f in r["s"]["fields"]] == [("a", "integer")]
    assert [(x["ok"], x["is_object"], x["keys"], x["values"]) for x in r["v"]] == [
        (True, True, ["a"], ["1"]), (True, True, ["a"], ["x"]), (False, False, None, None)]


def test_first_user_turn_missing_and_unknown_keys(spark):
    from tabwright.operators import evaluate as EV
    df = spark.createDataFrame([(1, [("system", "s")], '{"zzz": "1"}', None)],
                               "k long, messages array<struct<role:string,content:string>>, generation_only string, "
                               "generation string")
    assert df.select(extract.first_user_turn("messages").alias("u")).first()["u"] == ""
    r = EV.sanity_flags(df, "k").first()          # no schema: keys mismatch, unknown key typed as string
    assert (r["json_ok"], r["keys_ok"], r["types_ok"]) == (True, False, True)


def test_every_schema_output_has_one_outcome(spark):
    rows = [(1, SCHEMA_OUT), (2, '{"schema": {"a": 1}}  \n'), (3, '{"schema": {"a": 1}} trailing'), (4, None), (5, ""), (6, "no marker"),
            (7, "### Final Schema:\n{}"), (8, "### Final Schema:\nnothing"), (9, '### Final Schema:\n{"T": {"column_headers": ["a"'),
            (10, '{"schema": {\n{"schema": {"late": true}}'), (11, '{"schema": [1,\n2]}\n### Final Schema:\n{"T": 3}'),
            (12, 'text {"schema": 1}\n### Final Schema:\n{"T": {"column_headers": [], "col_headers": ["b", 4, "c"]}, "U": []}')]
    out = extract.schema_outcomes(spark.createDataFrame(rows, "k long, raw string"), "k", "raw")
    got = {r["k"]: (r["kind"], r["reason"]) for r in out.collect()}
    assert got == {1: ("final", None), 2: ("explicit", None), 3: ("rejected", extract.BROKEN_SCHEMA),
                   4: ("rejected", extract.NO_OUTPUT), 5: ("rejected", extract.NO_SCHEMA), 6: ("rejected", extract.NO_SCHEMA),
                   7: ("rejected", extract.EMPTY_SCHEMA), 8: ("rejected", extract.BROKEN_SCHEMA),
                   9: ("rejected", extract.BROKEN_SCHEMA), 10: ("explicit", None), 11: ("explicit", None), 12: ("final", None)}
    text = {r["k"]: json.loads(r["schema_json"]) for r in out.filter("kind = 'explicit'").collect()}
    assert text == {2: {"schema": {"a": 1}}, 10: {"schema": {"late": True}}, 11: {"schema": [1, 2]}}
    heads = extract.final_schema_headers(out, "k").filter("k = 12").orderBy("table_pos", "header_pos").collect()
    assert [(r["table_pos"], r["table_name"], r["header_pos"], r["header"]) for r in heads] == [
        (0, "T", 0, "b"), (0, "T", 1, "c"), (1, "U", None, None)]


def test_every_table_output_has_one_outcome(spark):
    rows = [(1, TABLE_OUT), (2, None), (3, ""), (4, "### T\n|a|\n|1|"), (5, "### Final Output Tables\n### \n|a|\n### T\ntext"),
            (6, "### Final Output Tables\n### T\n|a|\n|1|")]
    df = spark.createDataFrame(rows, "k long, raw string")
    long = extract.parse_markdown_tables_long(df, "k", "raw", with_rejects=True)
    rejects = {r["k"]: r["reason"] for r in long.filter("kind = 'reject'").collect()}
    assert rejects == {2: extract.NO_OUTPUT, 3: extract.NO_TABLES, 4: extract.NO_TABLES, 5: extract.NO_TABLE}
    assert sorted(r["k"] for r in long.filter("kind = 'header'").select("k").distinct().collect()) == [1, 6]
    plain = extract.parse_markdown_tables_long(df, "k", "raw")
    assert sorted(map(str, plain.collect())) == sorted(map(str, long.filter("kind != 'reject'").drop("reason").collect()))


def test_reasons_are_counted_while_the_result_is_computed(spark):
    from pyspark.sql import Observation

    from tabwright.operators import validate
    df = spark.createDataFrame([(1, "", "t"), (2, None, None), (3, "s", None), (4, "", None)], "id long, summary string, text string")
    obs = Observation()
    marked = validate.observe_reasons(validate.with_input_text(df), obs, [validate.NO_TEXT])
    ok, bad = validate.split_on_reason(marked)
    assert sorted((r["id"], r["input_text"]) for r in ok.collect()) == [(1, "t"), (3, "s")]      # a sort would read twice
    assert obs.get == {"n_rows": 4, "n_rejected": 2, validate.NO_TEXT: 2}
    assert [r["id"] for r in bad.orderBy("id").collect()] == [2, 4]


def test_integer_cells_are_what_python_reads(spark):
    texts = ["5", "+5", "-007", "1_000", "1__0", "_1", "1_", "\u0661\u0662", "\uff11", "9223372036854775807", "9223372036854775808",
             "-123456789012345678901234567890", "+00099999999999999999999", "-", "1.0", "1 2", " 7 ", "\u00b2", "None", "", None, "0", "-0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", T.convert_cell("t").alias("c")).collect()}
    shown = {r["i"]: r["s"] for r in df.select("i", T.cell_text(T.convert_cell("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        s = (t or "").strip()
        try:
            want = None if s == "" or s.lower() in ("none", "null") else s if "_" in s else int(s)
        except ValueError:
            want = s
        assert shown[i] == str(want), t
        if isinstance(want, int):
            assert got[i]["kind"] == "int" and got[i]["i"] == (want if abs(want) < 2 ** 63 else None)
