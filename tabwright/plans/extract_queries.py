"""Round-trip queries for the extraction jobs.

Model outputs are rendered from the driver tables, parsed back, and the
oracle is computed from the base tables directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import extract, messages, validate
from . import message_queries as MQ
from . import sqltext as S
from .registry import ORACLES, query, table


def _doc_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.filter(F.transform(T.py_lines("text"), T.py_strip), lambda x: x != "").alias("st"))


_DOC_ST_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(list_transform({S.lines('text')}, lambda y: {S.strip('y')}), lambda y: y <> '') AS st
           FROM documents)"""


# X2 F11 ------------------------------------------------------------------------------------
@query("statements_round_trip", sql=_DOC_ST_SQL + """
SELECT doc_id, len(st)::BIGINT AS n_statements, md5(array_to_string(st, chr(10))) AS statements_md5 FROM d
""")
def statements_round_trip(spark, sf_dir):
    d = _doc_statements(spark, sf_dir)
    raw = F.concat(F.lit("Table:\n|x|\n\nStatements:\n"), T.number_lines("st"), F.lit("\n\nRows:\n1. |x|"))
    got = extract.with_numbered_statements(d.select("doc_id", raw.alias("raw")), "raw", "got")
    return got.select("doc_id", F.size("got").cast("bigint").alias("n_statements"),
                      F.md5(F.array_join("got", "\n")).alias("statements_md5"))


# X1 -------------------------------------------------------------------------------------
@query("atomic_marker_round_trip", sql=_DOC_ST_SQL + f""",
s AS (SELECT doc_id, st,
             list_position(list_transform(st, lambda y: starts_with(y, '***') OR starts_with(y, '<REASONING STEPS>')), true) AS stop
      FROM d),
k AS (SELECT doc_id, CASE WHEN stop IS NULL OR stop = 0 THEN st ELSE st[1:stop - 1] END AS kept FROM s)
SELECT doc_id, len(kept)::BIGINT AS n_statements, md5(array_to_string(kept, chr(10))) AS statements_md5 FROM k
""")
def atomic_marker_round_trip(spark, sf_dir):
    d = _doc_statements(spark, sf_dir)
    raw = F.concat(F.lit("<REASONING STEPS>\nread the text\n\n" + K.ATOMIC_MARKER + "\n"),
                   F.array_join("st", "\n"), F.lit("\n***\nend"))
    got = extract.with_atomic_statements(d.select("doc_id", raw.alias("raw")), "raw", "got")
    return got.select("doc_id", F.size("got").cast("bigint").alias("n_statements"),
                      F.md5(F.array_join("got", "\n")).alias("statements_md5"))


# X4 F6 M13 ---------------------------------------------------------------------------------
ORDER_COLS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
LINE_COLS = ["l_linenumber", "l_partkey", "l_quantity"]


def _rendered_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *MQ.LINE_ORDER, F.array(*[F.col(c).cast("string") for c in LINE_COLS]).alias("row"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*MQ.LINE_ORDER, "row"))).alias("r"))
    o = table(spark, sf_dir, "orders").select(*ORDER_COLS)
    rec = o.join(rows, o.o_orderkey == rows.l_orderkey)
    order_md = messages.table_to_markdown(F.array(*[F.lit(c) for c in ORDER_COLS]),
                                          F.array(F.array(*[F.col(c).cast("string") for c in ORDER_COLS])))
    line_md = messages.table_to_markdown(F.array(*[F.lit(c) for c in LINE_COLS]),
                                         F.transform("r", lambda x: x["row"]))
    raw = F.concat(F.lit("Reasoning.\n\n" + K.FINAL_TABLES_MARKER + ":\n\n### Order\n"), order_md,
                   F.lit("\n\n### Lines\n"), line_md, F.lit("\n"))
    return rec.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


def _int_sql(x):
    return f"(CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN 1 ELSE 0 END)"


@query("tables_round_trip", sql=f"""
SELECT o_orderkey AS id, 0::BIGINT AS table_pos, 'Order' AS table_name, '{",".join(ORDER_COLS)}' AS headers,
       1::BIGINT AS n_rows,
       ({" + ".join(_int_sql(f"CAST({c} AS VARCHAR)") for c in ORDER_COLS)})::BIGINT AS n_int_cells,
       {" || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in ORDER_COLS)} AS body
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT l_orderkey, 1, 'Lines', '{",".join(LINE_COLS)}', count(*)::BIGINT,
       sum({" + ".join(_int_sql(f"CAST({c} AS VARCHAR)") for c in LINE_COLS)})::BIGINT,
       string_agg({" || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in LINE_COLS)}, chr(10) ORDER BY {MQ._LINE_ORDER_SQL})
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
""")
def tables_round_trip(spark, sf_dir):
    p = extract.parse_markdown_tables_long(_rendered_tables(spark, sf_dir), "id", "raw")
    is_row = F.col("kind") == "row"
    line = F.array_join(F.transform("cells", T.cell_text), "|")
    n_int = F.size(F.filter("cells", lambda c: c["kind"] == "int"))
    agg = p.groupBy("id", "table_name").agg(
        F.max("table_pos").cast("bigint").alias("table_pos"),
        F.max("headers").alias("headers"),
        F.count(F.when(is_row, 1)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(is_row, n_int)), F.lit(0)).cast("bigint").alias("n_int_cells"),
        F.sort_array(F.collect_list(F.when(is_row, F.struct("row_pos", line.alias("line"))))).alias("ls"))
    return agg.select("id", "table_pos", "table_name", F.array_join("headers", ",").alias("headers"),
                      "n_rows", "n_int_cells",
                      F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))


# M7 M8 X5 X6 X7 -------------------------------------------------------------------------
@query("ndjson_round_trip", sql=f"""
SELECT l_orderkey AS id, {len(MQ.SCHEMA_COLS)}::BIGINT AS n_fields, '{",".join(MQ.SCHEMA_COLS)}' AS field_names,
       count(*)::BIGINT AS n_lines, true AS all_parsed,
       string_agg({" || '|' || ".join(
           (f"{S.strip(f'CAST({c} AS VARCHAR)')}" if c in MQ.TABLE_COLS else "''") for c in MQ.SCHEMA_COLS)},
           chr(10) ORDER BY {MQ._LINE_ORDER_SQL}) AS cells
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
""")
def ndjson_round_trip(spark, sf_dir):
    rec = MQ._order_tables(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), "text", F.col("o_orderstatus").alias("split"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("table_id"),
        F.array(*[F.lit(c) for c in MQ.SCHEMA_COLS]).alias("schema_names"),
        F.array(*[F.lit(c) for c in MQ.TABLE_COLS]).alias("table_names"), "rows")
    m = messages.table_stage_rows(rec)
    schema = extract.schema_from_user_turn(extract.first_user_turn("messages"))
    gen = F.try_element_at(F.filter("messages", lambda x: x["role"] == "assistant"), F.lit(1))["content"]
    v = m.select("id", schema.alias("schema"), extract.ndjson_rows(gen).alias("v"))
    return v.select(
        "id", F.size("schema.fields").cast("bigint").alias("n_fields"),
        F.array_join(F.transform("schema.fields", lambda f: f["name"]), ",").alias("field_names"),
        F.size("v").cast("bigint").alias("n_lines"),
        F.forall("v", lambda x: x["ok"] & x["is_object"]).alias("all_parsed"),
        F.array_join(F.transform("v", lambda x: F.array_join(x["values"], "|")), "\n").alias("cells"))


# X3 A5 -----------------------------------------------------------------------------------
def _schema_outputs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")

    def entry(name, headers):
        return F.concat(F.lit('  '), T.json_string(name), F.lit(': {"row_headers": [], "column_headers": '),
                        T.json_string_array(headers), F.lit("}"))
    # the two table entries are separated by a newline only: the missing comma is repaired
    block = F.concat(F.lit("{\n"), entry(F.col("p_type"), words), F.lit("\n"),
                     entry(F.col("p_brand"), F.concat(F.array("p_type"), words)), F.lit("\n}"))
    raw = F.concat(F.lit("Steps: read the statements.\n\n" + K.FINAL_SCHEMA_MARKER + "\n"), block,
                   F.lit("\n\nDone."))
    return p.select(F.col("p_partkey").alias("record_id"), raw.alias("raw"))


@query("schema_block_round_trip", sql=ORACLES["header_schema_fields"])
def schema_block_round_trip(spark, sf_dir):
    from pyspark.sql import Window
    _, fields = extract.parse_schema_outputs(_schema_outputs(spark, sf_dir), "record_id", "raw")
    w = Window.partitionBy("record_id").orderBy("grp", "p1", "p2")
    return fields.select("record_id", "schema_id", F.row_number().over(w).cast("bigint").alias("field_rank"),
                         "name", "type", "required")


# Every record is a result or a reject with its reason ----------------------------
def _faulty_outputs(spark, sf_dir):
    """Schema-stage outputs of parts; their kind follows the brand's first digit and the size.

    1: an explicit schema line, 2: one broken off, then a final block; 3: a final block with a missing comma;
    4: a final block that never closes; others: no schema, no text at all for sizes up to 10.
    """
    p = table(spark, sf_dir, "part")
    words = T.json_string_array(F.split("p_name", " "))
    digit = F.substring(F.regexp_extract("p_brand", r"(\d+)", 1), 1, 1)
    entry = F.concat(F.lit('{"Part": {"row_headers": [], "column_headers": '), words, F.lit("}"))
    explicit = F.concat(F.lit('Steps.\n  {"schema": {"schema_id": "p'), F.col("p_partkey").cast("string"),
                        F.lit('",\n "fields": []}}\nDone {}.'))
    broken = F.concat(F.lit('{"schema": {"schema_id": \n'), F.lit(K.FINAL_SCHEMA_MARKER + "\n"), entry, F.lit("}\nend"))
    comma = F.concat(F.lit(K.FINAL_SCHEMA_MARKER + "\n"), entry, F.lit('\n "Size": {"col_headers": ["n", 3, null]}\n}'))
    open_ = F.concat(F.lit(K.FINAL_SCHEMA_MARKER + "\n"), entry)
    raw = (F.when(digit == "1", explicit).when(digit == "2", broken).when(digit == "3", comma).when(digit == "4", open_)
           .when(F.col("p_size") > 10, F.concat(F.lit("Nothing but "), F.col("p_name"))))
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"))


_DIGIT_SQL = "substr(regexp_extract(p_brand, '([0-9]+)'), 1, 1)"


@query("schema_outcomes", sql=f"""
WITH d AS (SELECT *, {_DIGIT_SQL} AS digit FROM part)
SELECT p_partkey AS id,
       CASE WHEN digit = '1' THEN 'explicit' WHEN digit IN ('2', '3') THEN 'final' ELSE 'rejected' END AS kind,
       CASE WHEN digit IN ('1', '2', '3') THEN NULL WHEN digit = '4' THEN 'broken schema JSON'
            WHEN p_size > 10 THEN 'no schema' ELSE 'no output' END AS reason,
       CASE digit WHEN '2' THEN len(string_split(p_name, ' ')) WHEN '3' THEN len(string_split(p_name, ' ')) + 1
            ELSE 0 END::BIGINT AS n_headers
FROM d
""")
def schema_outcomes(spark, sf_dir):
    """One outcome per record, and the headers of those that have a final block."""
    out = extract.schema_outcomes(_faulty_outputs(spark, sf_dir), "id", "raw")
    heads = extract.final_schema_headers(out, "id").groupBy("id").agg(F.count("header").alias("n"))
    return out.join(heads, "id", "left").select("id", "kind", "reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_headers"))


@query("table_outcomes", sql=f"""
WITH d AS (SELECT *, {_DIGIT_SQL} AS digit FROM part),
o AS (SELECT *, CASE WHEN digit = '1' THEN 'table' WHEN digit = '2' THEN 'no table with a name and headers'
                     WHEN digit = '3' THEN 'no tables section' ELSE 'no output' END AS outcome FROM d)
SELECT outcome, count(*)::BIGINT AS n_records, count(*) FILTER (WHERE outcome = 'table')::BIGINT * 2 AS n_lines FROM o GROUP BY outcome
""")
def table_outcomes(spark, sf_dir):
    """Records by outcome of the table parser, with the lines of those that have a table."""
    p = table(spark, sf_dir, "part")
    digit = F.substring(F.regexp_extract("p_brand", r"(\d+)", 1), 1, 1)
    good = F.concat(F.lit(K.FINAL_TABLES_MARKER + "\n### Part\n| name | size |\n| "), F.col("p_name"), F.lit(" | "),
                    F.col("p_size").cast("string"), F.lit(" |"))
    raw = (F.when(digit == "1", good).when(digit == "2", F.lit(K.FINAL_TABLES_MARKER + "\n### Part\nno lines"))
           .when(digit == "3", F.concat(F.lit("### Part\n| a |\n| "), F.col("p_name"), F.lit(" |"))))
    long = extract.parse_markdown_tables_long(p.select("p_partkey", raw.alias("raw")), "p_partkey", "raw", with_rejects=True)
    return long.groupBy(F.coalesce("reason", F.lit("table")).alias("outcome")).agg(
        F.count_distinct("p_partkey").cast("bigint").alias("n_records"),
        F.count(F.when(F.col("kind") != "reject", 1)).cast("bigint").alias("n_lines"))


@query("input_text_rejects", sql="""
SELECT doc_id, CASE WHEN lang = 'de' THEN md5(text) WHEN lang IN ('fr', 'en') THEN md5(lang) END AS text_md5,
       CASE WHEN lang = 'es' THEN 'no ''summary'' or ''text''' END AS reason
FROM documents
""")
def input_text_rejects(spark, sf_dir):
    """German records have a text and an empty summary, French and English ones a summary, Spanish ones neither."""
    d = table(spark, sf_dir, "documents")
    rec = d.select("doc_id", F.when(F.col("lang") == "de", F.lit("")).when(F.col("lang") != "es", F.col("lang")).alias("summary"),
                   F.when(F.col("lang") == "de", F.col("text")).alias("text"))
    ok, bad = validate.split_on_reason(validate.with_input_text(rec))
    return (ok.select("doc_id", F.md5("input_text").alias("text_md5"), F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("text_md5"), "reason")))
