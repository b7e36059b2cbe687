"""Round-trip properties: parse(render(x)) == x on generated inputs."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.functions import text as T
from tabwright.operators import extract, messages

WORD = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cc", "Cs", "Zl", "Zp", "Zs")),
               min_size=1, max_size=8)
CELL = st.lists(WORD, min_size=1, max_size=3).map(" ".join).filter(lambda s: "|" not in s and s.strip() == s)
STATEMENT = CELL.filter(lambda s: not s.startswith(("***", "<REASONING STEPS>")))
SETTINGS = settings(max_examples=10, deadline=None)


@SETTINGS
@given(st.lists(st.lists(STATEMENT, max_size=6), min_size=1, max_size=4))
def test_numbered_statements_round_trip(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "k long, st array<string>")
    raw = F.concat(F.lit("Table:\n|x|\n\nStatements:\n"), T.number_lines("st"), F.lit("\n\nRows:\n"))
    got = extract.with_numbered_statements(df.select("k", raw.alias("raw")), "raw", "s")
    assert {r["k"]: r["s"] for r in got.collect()} == dict(enumerate(docs))


@SETTINGS
@given(st.lists(STATEMENT, max_size=6))
def test_atomic_statements_round_trip(spark, statements):
    df = spark.createDataFrame([(statements,)], "st array<string>")
    raw = F.concat(F.lit("reasoning\n### Atomic Statements:\n"), F.array_join("st", "\n"), F.lit("\n***"))
    got = extract.with_atomic_statements(df.select(raw.alias("raw")), "raw", "s").first()["s"]
    assert got == statements


@SETTINGS
@given(st.integers(1, 4).flatmap(lambda n: st.tuples(
    st.lists(CELL, min_size=n, max_size=n),
    st.lists(st.lists(CELL, min_size=n, max_size=n), min_size=1, max_size=4))))
def test_markdown_table_round_trip(spark, table):
    headers, rows = table
    df = spark.createDataFrame([(1, headers, rows)], "k long, h array<string>, d array<array<string>>")
    md = messages.table_to_markdown(F.col("h"), F.col("d"))
    raw = df.select("k", F.concat(F.lit("### Final Output Tables:\n### T\n"), md).alias("raw"))
    tables, parsed = extract.parse_markdown_tables(raw, "k", "raw")
    assert tables.first()["headers"] == headers
    back = [[T_text(c) for c in r["cells"]] for r in parsed.orderBy("row_pos").collect()]
    assert back == [[c if not _is_int(c) and c.lower() not in ("none", "null") else _conv(c) for c in r] for r in rows]


def _is_int(c):
    import re
    return re.fullmatch(r"[+-]?[0-9]+", c) is not None


def _conv(c):
    return None if c.lower() in ("none", "null") else int(c)


def T_text(c):
    return None if c is None else (c["i"] if c["kind"] == "int" else c["s"])


@SETTINGS
@given(st.lists(st.tuples(CELL, CELL), min_size=1, max_size=4))
def test_ndjson_round_trip(spark, rows):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], [[x, y] for x, y in rows])],
                               "s array<string>, t array<string>, d array<array<string>>")
    nd = df.select(messages.render_ndjson("s", "t", "d").alias("nd")).first()["nd"]
    assert [json.loads(line) for line in nd.split("\n")] == [{"a": y, "b": x} for x, y in rows]
    staged = df.select(messages.render_ndjson("s", "t", "d").alias("nd"))
    v = staged.select(extract.ndjson_rows("nd").alias("v")).first()["v"]
    assert [tuple(x["values"]) for x in v] == [(y, x) for x, y in rows]
