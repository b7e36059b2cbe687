"""Queries for header naming, schema objects and training/prompt rows
(F3, F4, F7-F11, F14-F17, A3-A5, M1-M13, P1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions import text as T
from ..operators import induce, messages
from . import sqltext as S
from .registry import query, table

MINIMAL_DESC = "Minimal schema induced from the document."
PROMPT_DESC = "Schema induced from the gold table."


# F3 F4 F7 F8 F10 ------------------------------------------------------------------
@query("header_names", sql=f"""
WITH h AS (SELECT p_partkey, p_name, p_type, p_brand,
                  list_concat(string_split(p_name, ' '), [p_type], string_split(p_name, ' ')) AS hs FROM part),
u AS (SELECT p_partkey, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
s AS (SELECT p_partkey, i, {S.snake('h')} AS sn FROM u),
w AS (SELECT p_partkey, i, sn,
             count(*) OVER (PARTITION BY p_partkey, sn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
      FROM s),
a AS (SELECT p_partkey, string_agg(sn, ',' ORDER BY i) AS snake_names,
             string_agg(CASE WHEN k = 1 THEN sn ELSE sn || '_' || k END, ',' ORDER BY i) AS unique_names
      FROM w GROUP BY p_partkey),
d AS (SELECT p_partkey, trim(replace(lower(p_type) || '_' || replace(p_name, ' ', '_'), '_', ' ')) AS base FROM part)
SELECT a.p_partkey, a.snake_names, a.unique_names, {S.snake_plain('h.p_brand')} AS brand_plain,
       array_to_string(list_transform(string_split_regex(d.base, '\\s+'),
                       lambda x: upper(x[1]) || lower(x[2:])), ' ') AS display_name,
       replace(lower(h.p_name), ' ', '_') AS safe_name
FROM a JOIN h ON a.p_partkey = h.p_partkey JOIN d ON a.p_partkey = d.p_partkey
""")
def header_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    snake = F.transform(F.concat(words, F.array("p_type"), words), T.snake_case)
    return p.select(
        "p_partkey",
        F.array_join(snake, ",").alias("snake_names"),
        F.array_join(T.unique_names(snake), ",").alias("unique_names"),
        T.snake_case_plain("p_brand").alias("brand_plain"),
        T.category_display_name(F.concat(F.lower("p_type"), F.lit("_"),
                                         F.replace("p_name", F.lit(" "), F.lit("_")))).alias("display_name"),
        T.safe_table_name("p_name").alias("safe_name"))


# A3 F9 F14 F15 ------------------------------------------------------------------------
@query("schema_ids", sql=f"""
WITH h AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_type]) AS hs FROM part),
u AS (SELECT p_partkey, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
s AS (SELECT p_partkey, i, {S.snake('h')} AS sn FROM u),
w AS (SELECT p_partkey, i, sn,
             count(*) OVER (PARTITION BY p_partkey, sn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
      FROM s),
n AS (SELECT p_partkey, i, CASE WHEN k = 1 THEN sn ELSE sn || '_' || k END AS nm, sn FROM w),
a AS (SELECT p_partkey, string_agg(nm, '|' ORDER BY i) AS names, count(*) AS cnt,
             arg_min(sn, i) AS first_sn, arg_max(sn, i) AS last_sn,
             string_agg('{{"name": "' || nm || '", "type": "string", "required": false}}', ', ' ORDER BY i) AS fields
      FROM n GROUP BY p_partkey),
b AS (SELECT *, CASE WHEN cnt = 2 AND first_sn IN ('slot', 'key', 'field', 'attribute', 'name', 'label', 'column', 'property')
                      AND last_sn IN ('value', 'val', 'text', 'content', 'data') THEN 'kv_single' ELSE 'flat_single_row' END AS structure
      FROM a),
c AS (SELECT *, 'auto.' || substr(sha1('part-' || p_partkey || '|' || structure || '|' || names), 1, 12) AS schema_id FROM b)
SELECT p_partkey, schema_id, structure,
       '{{"schema_id": "' || schema_id || '", "structure": "' || structure || '", "description": "{MINIMAL_DESC}", "fields": [' || fields || ']}}' AS schema_json
FROM c
""")
def schema_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    headers = F.concat(F.split("p_name", " "), F.array("p_type"))
    sch = induce.minimal_schema(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), headers)
    return p.select("p_partkey", sch.alias("s")).select(
        "p_partkey", F.col("s.schema_id").alias("schema_id"), F.col("s.structure").alias("structure"),
        induce.minimal_schema_json(F.col("s"), MINIMAL_DESC).alias("schema_json"))


# A5 F4 F17 ------------------------------------------------------------------------
@query("header_schema_fields", sql=f"""
WITH t AS (
  SELECT p_partkey AS record_id, 0 AS table_pos, p_type AS table_name, string_split(p_name, ' ') AS hs FROM part
  UNION ALL
  SELECT p_partkey, 1, p_brand, list_concat([p_type], string_split(p_name, ' ')) FROM part),
h AS (SELECT record_id, table_pos, unnest(hs) AS header, generate_subscripts(hs, 1) - 1 AS header_pos FROM t),
f AS (
  SELECT record_id, lower(table_name) || '_name' AS name, 0 AS grp, table_pos AS p1, 0 AS p2,
         'string' AS type, table_pos = 0 AS required FROM t
  UNION ALL
  SELECT record_id, {S.snake_plain('header')}, 1, table_pos, header_pos,
         CASE WHEN regexp_matches({S.snake_plain('header')}, 'name|id|team|player|city') THEN 'string' ELSE 'integer' END,
         false
  FROM h WHERE {S.snake_plain('header')} <> ''),
firsts AS (SELECT record_id, name, arg_min(type, (grp, p1, p2)) AS type, arg_min(required, (grp, p1, p2)) AS required,
                  min((grp, p1, p2)) AS k FROM f GROUP BY record_id, name),
sid AS (SELECT record_id, string_agg(lower(table_name), '_' ORDER BY table_pos) || '_schema' AS schema_id FROM t GROUP BY record_id)
SELECT firsts.record_id, sid.schema_id,
       row_number() OVER (PARTITION BY firsts.record_id ORDER BY k)::BIGINT AS field_rank,
       name, type, required
FROM firsts JOIN sid ON firsts.record_id = sid.record_id
""")
def header_schema_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t0 = p.select(F.col("p_partkey").alias("record_id"), F.lit(0).alias("table_pos"),
                  F.col("p_type").alias("table_name"), F.posexplode(F.split("p_name", " ")).alias("header_pos", "header"))
    t1 = p.select(F.col("p_partkey").alias("record_id"), F.lit(1).alias("table_pos"),
                  F.col("p_brand").alias("table_name"),
                  F.posexplode(F.concat(F.array("p_type"), F.split("p_name", " "))).alias("header_pos", "header"))
    f = induce.header_schema_fields(t0.unionByName(t1))
    w = Window.partitionBy("record_id").orderBy("grp", "p1", "p2")
    return f.select("record_id", "schema_id", F.row_number().over(w).cast("bigint").alias("field_rank"),
                    "name", "type", "required")


# A4 F16 M6 M7 M8 --------------------------------------------------------------------
SCHEMA_COLS = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_comment"]
TABLE_COLS = ["l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
# Line numbers repeat within an order in the driver data: order rows by enough
# columns that any remaining tie is between identical rendered rows.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
_LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def _order_tables(spark, sf_dir):
    """Each order as a record holding its line-item table (rows in line order)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *LINE_ORDER,
        F.array(*[F.col(c).cast("string") for c in TABLE_COLS]).alias("row"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "row"))).alias("r"))
    rows = rows.select("l_orderkey", F.transform("r", lambda x: x["row"]).alias("rows"))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was placed on "),
                 F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" with priority "),
                 F.col("o_orderpriority"), F.lit(".")).alias("text"))
    return o.join(rows, o.o_orderkey == rows.l_orderkey).drop("l_orderkey")


_ORDER_DOC_SQL = ("'Order ' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%Y-%m-%d') "
                  "|| ' with priority ' || o_orderpriority || '.'")


def _table_stage_sql():
    def val(c):
        return S.json_str(S.strip(f"CAST({c} AS VARCHAR)")) if c in TABLE_COLS else "'\"\"'"
    line = " || ', ' || ".join(f"'\"{c}\": ' || {val(c)}" for c in SCHEMA_COLS)
    fields = ", ".join('{"name": "%s", "type": "string", "required": true}' % c for c in SCHEMA_COLS)
    pschema = ("'{\"schema_id\": \"order_' || o_orderkey || '\", \"structure\": \"flat_single_row\", "
               f"\"description\": \"{PROMPT_DESC}\", \"fields\": [{fields}]}}'")
    user = (f"{S.lit(PR.TABLE_POLICY + chr(10) + chr(10) + '[SCHEMA]' + chr(10))} || ps || "
            f"{S.lit(chr(10) * 2 + '<|document|>' + chr(10) * 2 + '[DOCUMENT]' + chr(10))} || doc || "
            f"{S.lit(chr(10) * 2 + PR.TABLE_OUTPUT_FORMAT + chr(10) * 2 + PR.TABLE_TASK)}")
    return f"""
WITH r AS (SELECT l_orderkey, string_agg('{{' || {line} || '}}', chr(10) ORDER BY {_LINE_ORDER_SQL}) AS nd
           FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderstatus, {_ORDER_DOC_SQL} AS doc, {pschema} AS ps FROM orders)
SELECT o_orderkey AS id, 3::BIGINT AS n_messages, 'order_' || o_orderkey AS table_id, o_orderstatus AS split,
       ps AS prompt_schema, md5({user}) AS user_md5, nd AS assistant
FROM o JOIN r ON o.o_orderkey = r.l_orderkey
"""


@query("table_stage_rows", sql=_table_stage_sql())
def table_stage_rows(spark, sf_dir):
    rec = _order_tables(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), "text", F.col("o_orderstatus").alias("split"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("table_id"),
        F.array(*[F.lit(c) for c in SCHEMA_COLS]).alias("schema_names"),
        F.array(*[F.lit(c) for c in TABLE_COLS]).alias("table_names"), "rows")
    out = messages.table_stage_rows(rec)
    return out.select("id", F.size("messages").cast("bigint").alias("n_messages"),
                      F.col("metadata.table_id").alias("table_id"), F.col("metadata.split").alias("split"),
                      "prompt_schema", F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                      F.col("messages")[2]["content"].alias("assistant"))


# M1-M5 P1 --------------------------------------------------------------------------
DOC_COLUMNS = ["lang", "source", "n_chars"]


def _schema_stage_sql():
    static = PR.metadata_static_values("en", "", "plain_text")
    parts = []
    for k in PR.METADATA_KEYS:
        v = "' || length(t) || '" if k == "document_char_len" else static[k].replace("'", "''")
        parts.append(PR.dumps(k) + ": " + v)
    md = "'{" + ", ".join(parts) + "}'"
    policy = PR.policy_block(PR.SCHEMA_POLICY_LINES)
    user = (f"{S.lit('<|policy|>' + chr(10) + policy + chr(10) * 2 + '<|metadata|>' + chr(10) + '[METADATA]' + chr(10))}"
            f" || {md} || {S.lit(chr(10) * 2 + '<|document|>' + chr(10) + '[DOCUMENT]' + chr(10))} || t || "
            f"{S.lit(chr(10) * 2 + '<|task|>' + chr(10) + '[TASK]' + chr(10) + PR.SCHEMA_SYSTEM)}")
    names = "|".join(DOC_COLUMNS)
    fields = ", ".join('{"name": "%s", "type": "string", "required": false}' % c for c in DOC_COLUMNS)
    return f"""
WITH d AS (SELECT doc_id, {S.strip("coalesce(text, '')")} AS t FROM documents),
k AS (SELECT doc_id, t, 'auto.' || substr(sha1(doc_id || '|flat_single_row|{names}'), 1, 12) AS sid FROM d WHERE t <> '')
SELECT doc_id, 3::BIGINT AS n_messages, sid AS schema_id, length({user})::BIGINT AS user_chars, md5({user}) AS user_md5,
       '{{"schema_id": "' || sid || '", "structure": "flat_single_row", "description": "{MINIMAL_DESC}", "fields": [{fields}]}}' AS assistant
FROM k
"""


@query("schema_stage_rows", sql=_schema_stage_sql())
def schema_stage_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.array(*[F.lit(c) for c in DOC_COLUMNS]).alias("column_names"))
    out = messages.schema_stage_rows(d, id_col="doc_id")
    return out.select("doc_id", F.size("messages").cast("bigint").alias("n_messages"), "schema_id",
                      T.char_len(F.col("messages")[1]["content"]).alias("user_chars"),
                      F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                      F.col("messages")[2]["content"].alias("assistant"))


def _dropout_sql():
    from ..functions import constants as K
    keep = ", ".join(f"'{k}'" for k in K.DROPOUT_KEEP_KEYS)
    keys = ", ".join(f"'{k}'" for k in PR.METADATA_KEYS)
    return f"""
WITH k AS (SELECT doc_id, unnest([{keys}]) AS key FROM documents),
d AS (SELECT key, key IN ({keep})
              OR CAST(('0x' || substr(md5('7|' || doc_id || '|' || key), 1, 13)) AS BIGINT) / {float(16 ** 13)} >= 0.5
              AS kept FROM k)
SELECT key, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE kept)::BIGINT AS n_kept FROM d GROUP BY key
"""


@query("metadata_dropout_rate", sql=_dropout_sql())
def metadata_dropout_rate(spark, sf_dir):
    """M3: share of documents keeping each metadata key at p = 0.5 (seeded)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    md = messages.metadata_json(F.col("text"), dropout=0.5, seed=7, record_id=F.col("doc_id"))
    keys = F.lit(PR.METADATA_KEYS)
    cells = d.select(md.alias("md")).select(F.explode(keys).alias("key"), "md")
    kept = cells.withColumn("kept", F.col("md").contains(F.concat(F.lit('"'), F.col("key"), F.lit('": '))))
    return kept.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"),
                                   F.count(F.when(F.col("kept"), 1)).cast("bigint").alias("n_kept"))


# M9 M10 M11 F11 ---------------------------------------------------------------------
def _doc_statements_col(text):
    return F.filter(F.transform(T.py_lines(text), T.py_strip), lambda x: x != "")


def _numbered_sql(x):
    return (f"array_to_string(list_transform(list_filter(list_transform({S.lines(x)}, lambda y: {S.strip('y')}), "
            f"lambda y: y <> ''), lambda y, i: i || '. ' || y), chr(10))")


@query("prompt_rows_documents", sql=f"""
WITH d AS (SELECT doc_id, text, lang, {_numbered_sql('text')} AS num FROM documents)
SELECT doc_id,
       md5({S.lit(PR.STATEMENT_USER_PREFIX)} || text || chr(10)) AS statement_user_md5,
       md5({S.lit(PR.SCHEMA_USER_HEAD)} || num || {S.lit(PR.SCHEMA_USER_TAIL)}) AS schema_user_md5,
       md5({S.lit(PR.TABLE_USER_HEAD)} || num || {S.lit(PR.TABLE_USER_MID)} || lang || {S.lit(PR.TABLE_USER_TAIL)}) AS table_user_md5,
       7::BIGINT AS n_turns
FROM d
""")
def prompt_rows_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang",
                                                 _doc_statements_col(F.col("text")).alias("st"))
    m9 = messages.statement_prompt(F.col("text"))
    m10 = messages.schema_prompt(F.col("st"))
    m11 = messages.table_prompt(F.col("st"), F.col("lang"))
    return d.select("doc_id", F.md5(m9[1]["content"]).alias("statement_user_md5"),
                    F.md5(m10[1]["content"]).alias("schema_user_md5"),
                    F.md5(m11[2]["content"]).alias("table_user_md5"),
                    (F.size(m9) + F.size(m10) + F.size(m11)).cast("bigint").alias("n_turns"))


# M12 M13 -------------------------------------------------------------------------------
@query("prompt_rows_tables", sql=f"""
WITH r AS (SELECT l_orderkey, string_agg('|' || {'|| \'|\' || '.join(f'CAST({c} AS VARCHAR)' for c in TABLE_COLS)} || '|', chr(10) ORDER BY {_LINE_ORDER_SQL}) AS body
           FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey AS id, '|{'|'.join(TABLE_COLS)}|' || chr(10) || body AS markdown FROM r)
SELECT id, markdown, md5({S.lit(PR.UNROLL_USER_PREFIX)} || markdown) AS unroll_user_md5 FROM m
""")
def prompt_rows_tables(spark, sf_dir):
    t = _order_tables(spark, sf_dir)
    md = messages.table_to_markdown(F.array(*[F.lit(c) for c in TABLE_COLS]), F.col("rows"))
    return t.select(F.col("o_orderkey").alias("id"), md.alias("markdown")).select(
        "id", "markdown", F.md5(messages.unroll_prompt(F.col("markdown"))[2]["content"]).alias("unroll_user_md5"))
