"""Queries for type, enum and key induction on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import induce
from .registry import query, table

# Text form of each judged column (dates shown as YYYY-MM-DD, rest cast).
TYPE_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "labels": ["doc_id", "quality", "toxic"],
}
DATE_COLUMNS = {"o_orderdate", "l_shipdate"}

_MISSING_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in K.MISSING_TOKENS)
_BOOL_SQL = ", ".join(f"'{t}'" for t in K.BOOL_TRUE + K.BOOL_FALSE)


def _spark_text(cols):
    return {c: F.date_format(c, "yyyy-MM-dd") for c in cols if c in DATE_COLUMNS}


def _sql_text(c):
    return f"strftime({c}, '%Y-%m-%d')" if c in DATE_COLUMNS else f"CAST({c} AS VARCHAR)"


def _sql_missing(v):
    return f"({v} IS NULL OR lower(trim({v})) IN ({_MISSING_SQL}))"


def _types_sql(tname):
    parts = []
    for i, c in enumerate(TYPE_TABLES[tname]):
        v = _sql_text(c)
        m = _sql_missing(v)
        p = f"NOT {m}"
        parts.append(f"""
  SELECT '{c}' AS column_name, {i} AS position, count(*) AS n, count(*) FILTER (WHERE {m}) AS miss,
    count(*) FILTER (WHERE {p} AND lower({v}) NOT IN ({_BOOL_SQL})) AS nb,
    count(*) FILTER (WHERE {p} AND NOT regexp_matches({v}, '{K.INT_PATTERN}')) AS ni,
    count(*) FILTER (WHERE {p} AND NOT regexp_matches({v}, '{K.DATE_PATTERN}')) AS nd,
    count(*) FILTER (WHERE {p} AND NOT ((regexp_matches({v}, '{K.FLOAT_PATTERN}') OR regexp_matches({v}, '{K.INT_PATTERN}'))
        AND (regexp_full_match({v}, '{K.NUMBER_FULL_PATTERN}') OR regexp_matches({v}, '{K.INT_PATTERN}')))) AS nn
  FROM {tname}""")
    body = " UNION ALL ".join(parts)
    return f"""
WITH f AS ({body}),
t AS (SELECT *, CASE WHEN n - miss = 0 THEN 'string' WHEN nb = 0 THEN 'boolean' WHEN ni = 0 THEN 'integer'
                     WHEN nd = 0 THEN 'date' WHEN nn = 0 THEN 'number' ELSE 'string' END AS type FROM f)
SELECT column_name, position, type,
       CASE WHEN type = 'date' THEN '{K.DATE_FORMAT}' END AS format,
       CASE WHEN type = 'date' THEN '{K.DATE_PATTERN}' END AS pattern,
       (n > 0 AND miss = 0) AS required, miss::BIGINT AS n_missing, n::BIGINT AS n_values
FROM t"""


def _types_query(tname):
    def run(spark, sf_dir):
        cols = TYPE_TABLES[tname]
        return induce.infer_column_types(table(spark, sf_dir, tname), cols, as_text=_spark_text(cols))
    run.__name__ = f"column_types_{tname}"
    return run


for _t in TYPE_TABLES:
    query(f"column_types_{_t}", sql=_types_sql(_t))(_types_query(_t))


# A2 / A9 ------------------------------------------------------------------------
ENUM_SOURCES = {
    "customer": ("c_custkey", ["c_mktsegment", "c_nationkey", "c_name"]),
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    "lineitem": ("l_orderkey * 16 + l_linenumber", ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"]),
}


def _enum_cells(spark, sf_dir):
    out = None
    for tname, (pos, cols) in ENUM_SOURCES.items():
        df = table(spark, sf_dir, tname)
        cells = induce.stack_cells(df, F.expr(pos).cast("bigint"), cols, as_text=_spark_text(cols))
        cells = cells.withColumn("table_name", F.lit(tname))
        out = cells if out is None else out.unionByName(cells)
    return out


def _enum_sql(n_distinct="CASE WHEN n.nd <= 10 THEN n.nd::BIGINT END"):
    parts = []
    for tname, (pos, cols) in ENUM_SOURCES.items():
        for c in cols:
            parts.append(f"SELECT '{tname}' AS t, '{c}' AS c, ({pos})::BIGINT AS pos, {_sql_text(c)} AS raw FROM {tname}")
    cells = " UNION ALL ".join(parts)
    return f"""
WITH cells AS ({cells}),
nm AS (SELECT t, c, pos, trim(raw) AS v FROM cells WHERE NOT {_sql_missing('raw')}),
g AS (SELECT t, c, lower(v) AS k, arg_min(v, pos) AS sp, min(pos) AS fp FROM nm GROUP BY t, c, lower(v)),
n AS (SELECT t, c, count(*) AS nd FROM g GROUP BY t, c),
e AS (SELECT t, c, string_agg(sp, '|' ORDER BY fp) AS ev FROM g GROUP BY t, c)
SELECT n.t AS table_name, n.c AS column_name, {n_distinct} AS n_distinct,
       CASE WHEN n.nd BETWEEN 2 AND 10 THEN e.ev END AS enum_values
FROM n JOIN e ON n.t = e.t AND n.c = e.c"""


@query("column_enums", sql=_enum_sql("n.nd::BIGINT"))
def column_enums(spark, sf_dir):
    """The distinct values of every column are counted, however many; enums are those of 2 to 10."""
    res = induce.small_enums(_enum_cells(spark, sf_dir), ["table_name", "column_name"], count_all=True)
    return res.select("table_name", "column_name", "n_distinct",
                      F.array_join("enum_values", "|").alias("enum_values"))


# A10 ----------------------------------------------------------------------------
KEY_TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_nationkey", "c_custkey", "c_name"],
    "supplier": ["s_nationkey", "s_suppkey", "s_name"],
    "part": ["p_brand", "p_partkey"],
    "orders": ["o_custkey", "o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"],
}


def _keys_sql():
    parts = []
    for tname, cols in KEY_TABLES.items():
        for i, c in enumerate(cols):
            v = f"CAST({c} AS VARCHAR)"
            parts.append(f"""SELECT '{tname}' AS t, {i} AS pos, '{c}' AS c, count(*) AS n,
  (count(DISTINCT {v}) = count(*) AND count(*) FILTER (WHERE {_sql_missing(v)}) = 0) AS ok FROM {tname}""")
    body = " UNION ALL ".join(parts)
    return f"""
WITH k AS ({body})
SELECT t AS table_name, arg_min(c, pos) FILTER (WHERE ok) AS key_column, max(n)::BIGINT AS n_rows
FROM k GROUP BY t"""


@query("primary_keys", sql=_keys_sql())
def primary_keys(spark, sf_dir):
    out = None
    for tname, cols in KEY_TABLES.items():
        r = induce.detect_primary_key(table(spark, sf_dir, tname), cols)
        r = r.select(F.lit(tname).alias("table_name"), "key_column", "n_rows")
        out = r if out is None else out.unionByName(r)
    return out


# A8 A9 (constraints) ---------------------------------------------------------------------
CONSTRAINT_TABLES = ["orders", "lineitem"]


def _constraints_sql():
    parts = []
    for t in CONSTRAINT_TABLES:
        parts.append(f"SELECT '{t}' AS table_name, * FROM ({_types_sql(t)})")
    types = " UNION ALL ".join(parts)
    return f"""
WITH ty AS ({types}),
en AS ({_enum_sql()})
SELECT ty.table_name, ty.column_name, ty.type, ty.required, ty.format, ty.pattern, en.enum_values
FROM ty LEFT JOIN en ON ty.table_name = en.table_name AND ty.column_name = en.column_name
"""


@query("schema_constraints", sql=_constraints_sql())
def schema_constraints(spark, sf_dir):
    types = None
    for t in CONSTRAINT_TABLES:
        cols = TYPE_TABLES[t]
        x = induce.infer_column_types(table(spark, sf_dir, t), cols, as_text=_spark_text(cols))
        x = x.withColumn("table_name", F.lit(t))
        types = x if types is None else types.unionByName(x)
    enums = induce.small_enums(_enum_cells(spark, sf_dir), ["table_name", "column_name"])
    enums = enums.withColumn("enum_values", F.array_join("enum_values", "|"))
    return induce.column_constraints(types, enums, ["table_name", "column_name"]).select(
        "table_name", "column_name", "type", "required", "format", "pattern", "enum_values")
