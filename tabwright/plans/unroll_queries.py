"""Queries for unrolling, format detection, statement splitting and
record validation (G4-G6, A6, A7, A10, P1-P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import json_tables, unroll, validate
from ..sources import files as SF
from ..sources import jsonl as JL
from . import message_queries as MQ
from . import sqltext as S
from .registry import query, table


def _unroll_sql(cells_cte: str, tcols: list[str]) -> str:
    """G4 over a ``cells(t..., row_pos, col_pos, col, v)`` CTE, as DuckDB SQL."""
    t = ", ".join(tcols)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in tcols)
    return f"""
WITH cells AS ({cells_cte}),
pv AS (SELECT {t}, col_pos, v, count(*) AS n FROM cells GROUP BY ALL),
pc AS (SELECT {t}, col_pos, max(n) AS max_n, max(CASE WHEN {S.missing('v')} THEN 1 ELSE 0 END) AS anym FROM pv GROUP BY ALL),
keys AS (SELECT {t}, min(col_pos) FILTER (WHERE max_n = 1 AND anym = 0) AS key_pos FROM pc GROUP BY ALL),
kv AS (SELECT {", ".join("cells." + c for c in tcols)}, cells.row_pos, {S.strip('cells.v')} AS key_value
       FROM cells JOIN keys ON {on('cells', 'keys')} AND cells.col_pos = keys.key_pos)
SELECT {", ".join("cells." + c for c in tcols)}, cells.row_pos, cells.col_pos,
       'The ' || cells.col || ' of ' || coalesce(kv.key_value, 'row ' || (cells.row_pos + 1)) || ' is '
       || {S.strip('cells.v')} || '.' AS statement
FROM cells JOIN keys ON {on('cells', 'keys')}
LEFT JOIN kv ON {on('cells', 'kv')} AND cells.row_pos = kv.row_pos
WHERE (keys.key_pos IS NULL OR cells.col_pos <> keys.key_pos) AND NOT {S.missing('cells.v')}
"""


# G4 A10 -----------------------------------------------------------------------------------------
CUSTOMER_COLS = ["c_mktsegment", "c_name", "c_acctbal", "c_custkey"]


@query("unroll_customer", sql=_unroll_sql(" UNION ALL ".join(
    f"SELECT c_nationkey AS table_id, c_custkey AS row_pos, {i} AS col_pos, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM customer"
    for i, c in enumerate(CUSTOMER_COLS)), ["table_id"]))
def unroll_customer(spark, sf_dir):
    """Customers of each nation form one table; unrolled through its key column."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("row_pos"),
                    F.array(*[F.lit(n) for n in CUSTOMER_COLS]).alias("headers"),
                    F.array(*[F.col(n).cast("string") for n in CUSTOMER_COLS]).alias("values"))
    return unroll.unroll_rows(rows, ["table_id"])


# G5 A7 F7 F8 ------------------------------------------------------------------------------------
ORDER_TABLE = "Order Info"
LINES_TABLE = "Line Items"
ORDER_COLS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
LINE_COLS = ["l_linenumber", "l_partkey", "l_quantity"]


def _named_tables(spark, sf_dir):
    """Per order: an ``Order Info`` table (one row) and a ``Line Items`` table."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *MQ.LINE_ORDER, F.array(*[F.col(c).cast("string") for c in LINE_COLS]).alias("row"))
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy(*MQ.LINE_ORDER)
    # cells are made behind the window, so that its shuffle and sort hold plain text
    li = li.withColumn("row_pos", (F.row_number().over(w) - 1).cast("bigint"))
    lrows = li.select(F.col("l_orderkey").alias("id"), F.lit(LINES_TABLE).alias("table_name"), "row_pos",
                      F.transform("row", T.convert_cell).alias("cells"))
    o = table(spark, sf_dir, "orders")
    orows = o.select(F.col("o_orderkey").alias("id"), F.lit(ORDER_TABLE).alias("table_name"),
                     F.lit(0).cast("bigint").alias("row_pos"),
                     F.transform(F.array(*[F.col(c).cast("string") for c in ORDER_COLS]), T.convert_cell).alias("cells"))
    rows = orows.unionByName(lrows)
    tables = (o.select(F.col("o_orderkey").alias("id"), F.lit(ORDER_TABLE).alias("table_name"),
                       F.array(*[F.lit(c) for c in ORDER_COLS]).alias("headers"))
              .unionByName(o.select(F.col("o_orderkey").alias("id"), F.lit(LINES_TABLE).alias("table_name"),
                                    F.array(*[F.lit(c) for c in LINE_COLS]).alias("headers"))))
    return tables, rows


def _named_cells_sql():
    parts = [f"SELECT o_orderkey AS id, '{ORDER_TABLE}' AS table_name, 0 AS row_pos, {i} AS col_pos, '{c}' AS col, "
             f"CAST({c} AS VARCHAR) AS v FROM orders" for i, c in enumerate(ORDER_COLS)]
    rn = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {MQ._LINE_ORDER_SQL}) - 1"
    parts += [f"SELECT l_orderkey, '{LINES_TABLE}', {rn}, {i}, '{c}', CAST({c} AS VARCHAR) FROM lineitem"
              for i, c in enumerate(LINE_COLS)]
    return " UNION ALL ".join(parts)


@query("unroll_named_tables", sql="WITH g AS (" + _unroll_sql(_named_cells_sql(), ["id", "table_name"]) + """)
SELECT id, table_name, replace(lower(table_name), ' ', '_') AS category,
       CASE WHEN table_name = 'Order Info' THEN 'Order Info' ELSE 'Line Items' END AS display_name,
       row_pos, col_pos, statement FROM g""")
def unroll_named_tables(spark, sf_dir):
    tables, rows = _named_tables(spark, sf_dir)
    return unroll.unroll_named_tables(tables, rows)


@query("table_names_distinct", sql=f"""
SELECT DISTINCT table_name, replace(lower(table_name), ' ', '_') AS safe_name FROM (
  SELECT '{ORDER_TABLE}' AS table_name FROM orders
  UNION ALL SELECT '{LINES_TABLE}' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
""")
def table_names_distinct(spark, sf_dir):
    tables, rows = _named_tables(spark, sf_dir)
    names = unroll.usable_table_names(tables, rows)
    return names.select("table_name", T.safe_table_name("table_name").alias("safe_name"))


# A6 ---------------------------------------------------------------------------------------------
@query("table_format_detection", sql="""
WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pivot' WHEN 'F' THEN 'multi' END AS fmt FROM orders)
SELECT coalesce(arg_min(fmt, o_orderkey) FILTER (WHERE fmt IS NOT NULL), 'unknown') AS format,
       count(*) FILTER (WHERE fmt = 'pivot')::BIGINT AS n_pivot,
       count(*) FILTER (WHERE fmt = 'multi')::BIGINT AS n_multi,
       count(*) FILTER (WHERE fmt IS NULL)::BIGINT AS n_unknown
FROM f
""")
def table_format_detection(spark, sf_dir):
    """Open orders carry a pivot table, finished ones a named-table dict, others neither."""
    o = table(spark, sf_dir, "orders")
    k = T.json_string(F.col("o_orderkey").cast("string"))
    pivot = F.concat(F.lit('{"columns": [{"name": "o_orderkey"}], "data": [['), k, F.lit("]]}"))
    multi = F.concat(F.lit('{"Order": {"headers": ["o_orderkey"], "rows": [['), k, F.lit("]]}}"))
    other = F.concat(F.lit('{"note": '), k, F.lit("}"))
    tj = (F.when(F.col("o_orderstatus") == "O", pivot).when(F.col("o_orderstatus") == "F", multi)
          .otherwise(other))
    return unroll.dataset_format(o.select("o_orderkey", tj.alias("table_json")), "o_orderkey", "table_json")


# G6 ----------------------------------------------------------------------------------------------
@query("doc_statements", sql=f"""
WITH d AS (SELECT doc_id, {S.lines('text')} AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS li FROM d),
p AS (SELECT doc_id, li, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM l),
q AS (SELECT doc_id, li, unnest(ps) AS s, generate_subscripts(ps, 1) AS pi FROM p),
r AS (SELECT doc_id, {S.strip('s')} AS s, min(li * 1000000 + pi) AS k FROM q WHERE {S.strip('s')} <> '' GROUP BY ALL),
a AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY k) AS j FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(a.n, 0)::BIGINT AS n_statements, md5(coalesce(a.j, '')) AS statements_md5
FROM documents LEFT JOIN a ON documents.doc_id = a.doc_id
""")
def doc_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", unroll.split_statements("text").alias("st"))
    return d.select("doc_id", F.size("st").cast("bigint").alias("n_statements"),
                    F.md5(F.array_join("st", "\n")).alias("statements_md5"))


# P1 P2 P3 P5 P7 P8 --------------------------------------------------------------------------------
def _merged_examples(spark, sf_dir):
    """Merged examples from documents and labels; faults follow the labels:
    toxic -> table id differs, quality 0 -> schema asks a column the table lacks,
    unlabelled -> empty table, German -> statements field written as a string."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    x = d.join(lab, "doc_id", "left")
    col = lambda n: F.struct(F.lit(n).alias("name"))
    schema_cols = F.when(F.col("quality") == 0, F.array(col("lang"), col("source"), col("quality"))).otherwise(
        F.array(col("lang"), col("source")))
    schema = F.struct(F.concat(F.lit("doc_"), F.col("lang")).alias("table_id"), schema_cols.alias("columns"))
    table_id = F.when(F.col("toxic") == 1, F.lit("doc_toxic")).otherwise(F.concat(F.lit("doc_"), F.col("lang")))
    data = F.when(F.col("quality").isNull(), F.array().cast("array<array<string>>")).otherwise(
        F.array(F.array(F.col("lang"), F.col("source"))))
    tbl = F.struct(table_id.alias("table_id"), F.array(col("lang"), col("source")).alias("columns"), data.alias("data"))
    summary = F.when(F.col("quality") == 1, F.lit("")).when(
        F.col("quality") == 0, F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(".")))
    stmts = F.when(F.col("lang") == "de", T.json_string(F.col("lang"))).otherwise(
        T.json_string_array(F.array(F.col("lang"), F.col("source"))))
    raw = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "atomic_statements": '), stmts, F.lit("}"))
    return x.select(F.col("doc_id").cast("string").alias("id"), "text", summary.alias("summary"),
                    schema.alias("schema"), tbl.alias("table"), raw.alias("raw"))


@query("record_violations", sql=f"""
WITH x AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
v AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, quality,
         list_filter([
           CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'missing/empty ''text''' END,
           CASE WHEN toxic = 1 THEN 'schema.table_id != table.table_id' END,
           CASE WHEN quality = 0 THEN 'table missing schema columns: quality' END], lambda s: s IS NOT NULL) AS vs,
         CASE WHEN quality = 1 THEN text WHEN quality = 0 THEN 'Document ' || doc_id || '.' ELSE text END AS used
  FROM x)
SELECT id, len(vs)::BIGINT AS n_violations, array_to_string(vs, '; ') AS violations,
       length(used)::BIGINT AS text_chars, quality IS NOT NULL AS nonempty_table,
       coalesce({S.strip('text')}, '') <> '' AS usable,
       CASE WHEN lang = 'de' THEN 1 ELSE 0 END::BIGINT AS n_type_errors
FROM v
""")
def record_violations(spark, sf_dir):
    ex = validate.with_violations(_merged_examples(spark, sf_dir))
    usable = (T.py_strip(F.coalesce("text", F.lit(""))) != "") & (F.coalesce(F.size("schema.columns"), F.lit(0)) > 0)
    types = validate.json_field_types("raw", {"atomic_statements": "array"})
    return ex.select("id", F.size("violations").cast("bigint").alias("n_violations"),
                     F.array_join("violations", "; ").alias("violations"),
                     F.length(validate.text_with_fallback()).cast("bigint").alias("text_chars"),
                     validate.nonempty_table().alias("nonempty_table"), usable.alias("usable"),
                     F.size(types).cast("bigint").alias("n_type_errors"))


# G4 + E3-E7: table -> statements -> score ------------------------------------------------------
def _customer_rows(c, acct, seg):
    return c.select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("row_pos"),
                    F.array(*[F.lit(n) for n in CUSTOMER_COLS]).alias("headers"),
                    F.array(seg, F.col("c_name"), acct.cast("string"), F.col("c_custkey").cast("string")).alias("values"))


def _perturbed_cells_sql(acct: str, seg: str) -> str:
    exprs = {"c_mktsegment": seg, "c_name": "c_name", "c_acctbal": f"CAST({acct} AS VARCHAR)",
             "c_custkey": "CAST(c_custkey AS VARCHAR)"}
    return " UNION ALL ".join(
        f"SELECT c_nationkey AS table_id, c_custkey AS row_pos, {i} AS col_pos, '{c}' AS col, {exprs[c]} AS v FROM customer"
        for i, c in enumerate(CUSTOMER_COLS))


@query("unroll_scores", sql=f"""
WITH g AS ({_unroll_sql(_perturbed_cells_sql("c_acctbal", "c_mktsegment"), ["table_id"])}),
p AS ({_unroll_sql(_perturbed_cells_sql("round(c_acctbal, 1)",
                                          "CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"),
                   ["table_id"])}),
ps AS (SELECT table_id, avg(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.table_id = p.table_id
                                              AND {S.strip('g.statement')} = {S.strip('p.statement')}) THEN 1.0 ELSE 0.0 END) AS precision
       FROM p GROUP BY table_id),
gs AS (SELECT table_id, avg(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.table_id = g.table_id
                                              AND {S.strip('p.statement')} = {S.strip('g.statement')}) THEN 1.0 ELSE 0.0 END) AS recall
       FROM g GROUP BY table_id),
j AS (SELECT ps.table_id AS id, precision, recall FROM ps JOIN gs ON ps.table_id = gs.table_id)
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM j
""")
def unroll_scores(spark, sf_dir):
    """Each nation's customer table unrolled into gold statements; a copy with
    rounded balances and lower-cased segments (for negative balances) is the
    prediction; exact-match soft precision / recall / F1 per nation."""
    from ..operators import evaluate as EV
    c = table(spark, sf_dir, "customer")
    gold_rows = _customer_rows(c, F.col("c_acctbal"), F.col("c_mktsegment"))
    pred_rows = _customer_rows(c, F.round("c_acctbal", 1),
                               F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    pos = (F.col("row_pos") * 16 + F.col("col_pos")).alias("pos")
    gold = unroll.unroll_rows(gold_rows, ["table_id"]).select(F.col("table_id").alias("id"), pos, "statement")
    pred = unroll.unroll_rows(pred_rows, ["table_id"]).select(F.lit("Team").alias("category"),
                                                              F.col("table_id").alias("id"), pos, "statement")
    ids = EV.aligned_ids(gold.select("id"), pred.select("id"))
    pb, gb = EV.best_scores(pred, gold, scorer="exact")
    # a row per nation, stored: the categories are looked up in it before it is joined
    prf = SF.materialize(lambda: EV.soft_prf(pb, gb), spark, SF.scratch_path(spark, "unroll-scores"), require_rows=False)
    ex = EV.per_example(prf, ids, ["Team"])
    return ex.select("id", *[F.round(x, 6).alias(x) for x in ["precision", "recall", "f1"]])


# G4 G5 A6 A7 P8 over JSON records ------------------------------------------------------------------
JSON_COLS = ["l_quantity", "l_linenumber", "l_returnflag"]


def _json_records(spark, sf_dir, named: bool):
    """JSON lines of orders with their line items as a table.

    Orders of status ``P`` have a null table, urgent ones a table without rows; the
    return flag of open lines is null.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("l_returnflag"))
    cells = F.concat(
        F.lit("["), F.array_join(F.array(*[F.coalesce(F.to_json(F.array(c)), F.lit("[null]")) for c in JSON_COLS]), ","), F.lit("]"))
    # a row's text is made before rows are gathered, and follows from the columns that order them
    text = F.regexp_replace(cells, r"\[([^\[\]]*)\](?=[,\]])", "$1").alias("text")
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", text))).alias("x"))
    data = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["text"]), ","), F.lit("]"))
    o = table(spark, sf_dir, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    data = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("[]")).otherwise(data)
    names = ", ".join(f'{{"name": "{c}"}}' for c in JSON_COLS) if not named else ", ".join(f'"{c}"' for c in JSON_COLS)
    if named:
        body = F.concat(F.lit('{"headers": [' + names + '], "rows": '), data, F.lit("}"))
        status = F.concat(F.lit('{"headers": ["status", "urgent"], "rows": [["'), F.col("o_orderstatus"), F.lit('", '),
                          (F.col("o_orderpriority") == "1-URGENT").cast("string"), F.lit("]]}"))
        body = F.concat(F.lit('{"Line Items": '), F.when(F.col("o_orderstatus") == "P", F.lit("null")).otherwise(body),
                        F.lit(', "Status": '), status, F.lit(', "None": 3}'))
    else:
        body = F.when(F.col("o_orderstatus") == "P", F.lit("null")).otherwise(
            F.concat(F.lit('{"columns": [' + names + '], "data": '), data, F.lit("}")))
    line = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "tables": '), body, F.lit("}"))
    return JL.with_fields(JL.with_records(o.select(line.alias("line"))), "id bigint")


_JSON_LINES_SQL = """
WITH x AS (
  SELECT o_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS n, CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) AS q,
         CASE WHEN l_linestatus <> 'O' THEN l_returnflag END AS f, l_linenumber, l_quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_quantity, f NULLS FIRST) AS pos FROM x),
k AS (SELECT id, CASE WHEN count(DISTINCT q) = count(*) THEN 1 WHEN count(DISTINCT n) = count(*) THEN 2
                      WHEN count(DISTINCT f) = count(*) THEN 3 END AS key_pos FROM x GROUP BY id),
c AS (SELECT r.id, pos, key_pos, unnest([q, n, f]) AS v, unnest(['l_quantity', 'l_linenumber', 'l_returnflag']) AS col,
             unnest([1, 2, 3]) AS col_pos,
             CASE key_pos WHEN 1 THEN q WHEN 2 THEN n WHEN 3 THEN f ELSE 'row ' || pos END AS subject
      FROM r JOIN k ON r.id = k.id),
lines AS (SELECT id, count(*)::BIGINT AS n_statements,
                 md5(string_agg('The ' || col || ' of ' || subject || ' is ' || v || '.', chr(10) ORDER BY pos, col_pos)) AS statements_md5
          FROM c WHERE v IS NOT NULL AND col_pos IS DISTINCT FROM key_pos GROUP BY id)
"""


@query("json_pivot_unroll", sql=_JSON_LINES_SQL + "SELECT * FROM lines")
def json_pivot_unroll(spark, sf_dir):
    t = json_tables.with_statements(json_tables.pivot_tables(_json_records(spark, sf_dir, False), "tables"))
    return t.select("id", F.size("statements").cast("bigint").alias("n_statements"),
                    F.md5(F.array_join(F.transform("statements", lambda s: s["statement"]), "\n")).alias("statements_md5"))


@query("json_named_unroll", sql=_JSON_LINES_SQL + """
SELECT id, 'Line Items' AS table_name, 'line_items' AS category, n_statements, statements_md5 FROM lines
UNION ALL
SELECT o_orderkey, 'Status', 'status', 1,
       md5('The urgent of ' || o_orderstatus || ' is ' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END || '.')
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def json_named_unroll(spark, sf_dir):
    t = json_tables.with_statements(json_tables.named_tables(_json_records(spark, sf_dir, True)))
    return t.select("id", "table_name", "category", F.size("statements").cast("bigint").alias("n_statements"),
                    F.md5(F.array_join(F.transform("statements", lambda s: s["statement"]), "\n")).alias("statements_md5"))


@query("json_table_names", sql="""
SELECT 'Status' AS table_name, 'multi' AS format, count(*)::BIGINT AS n_records
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
UNION ALL
SELECT 'Line Items', 'multi', count(*)::BIGINT FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
HAVING count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT') > 0
""")
def json_table_names(spark, sf_dir):
    """Usable names of the whole data set (A7) beside its format."""
    rec = _json_records(spark, sf_dir, True)
    kinds = json_tables.table_kind(rec, "tables").groupBy("format").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"))
    return json_tables.table_names(rec).join(kinds, F.col("format") == "multi")
