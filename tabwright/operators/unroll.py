"""Table unrolling into statements and table-format detection.

Deterministic re-aim of what the original asks a model to do: a table is
unrolled through its key column (A10 per table) into one sentence per
non-missing, non-key cell.  Key detection is an aggregation per (table,
column, value) over exploded cells and sentence building is a projection of
the rows joined to one key row per table; nothing gathers a table into one
row, and a huge table is split by value rather than held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def table_keys(cells: DataFrame, table_cols: list[str], na_token: str = "") -> DataFrame:
    """A10 per table: ``(table..., key_pos)``; null when no column qualifies.

    ``cells``: ``(table..., row_pos, col_pos, column, value)``.  A column is
    a key when no value is missing and no value repeats within the table.
    """
    per_val = cells.groupBy(*table_cols, "col_pos", "value").agg(F.count(F.lit(1)).alias("n"))
    per_col = per_val.groupBy(*table_cols, "col_pos").agg(
        F.max("n").alias("max_n"),
        F.max(T.is_missing(F.col("value"), na_token).cast("int")).alias("any_missing"))
    ok = (F.col("max_n") == 1) & (F.col("any_missing") == 0)
    return per_col.groupBy(*table_cols).agg(F.min(F.when(ok, F.col("col_pos"))).alias("key_pos"))


def unroll_rows(rows: DataFrame, table_cols: list[str], headers_col: str = "headers",
                values_col: str = "values", row_pos_col: str = "row_pos", na_token: str = "",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """``The <column> of <key value> is <value>.`` per non-key, non-missing cell.

    ``rows``: one row per table row with its ``headers`` and text ``values``
    (a short row leaves the rest missing).  Without a key column the
    subject is ``row <n>`` (1-based).  Returns ``(table..., carry..., row_pos,
    col_pos, statement)``; row-major order is ``(row_pos, col_pos)``.  ``carry``
    names columns of the rows that their statements keep.

    Key detection aggregates exploded cells (partial aggregation splits a
    huge table by value); the per-table key relation is then joined back to
    the rows, so the key value is an array lookup, not a cell self-join.
    """
    cells = rows.select(*table_cols, values_col, F.posexplode(headers_col).alias("col_pos", "column"))
    cells = cells.select(*table_cols, "col_pos",
                         F.try_element_at(F.col(values_col), (F.col("col_pos") + 1).cast("int")).alias("value"))
    keys = table_keys(cells, table_cols, na_token)
    r = rows.join(keys, table_cols, "left")
    key_value = F.when(F.col("key_pos").isNotNull(),
                       T.py_strip(F.try_element_at(F.col(values_col), (F.col("key_pos") + 1).cast("int"))))
    r = r.select(*table_cols, *carry, F.col(row_pos_col).alias("row_pos"), "key_pos", key_value.alias("key_value"),
                 values_col, F.posexplode(headers_col).alias("col_pos", "column"))
    r = r.withColumn("value", F.try_element_at(F.col(values_col), (F.col("col_pos") + 1).cast("int")))
    body = r.filter((F.col("key_pos").isNull() | (F.col("col_pos") != F.col("key_pos")))
                    & ~T.is_missing(F.col("value"), na_token))
    subject = F.coalesce(F.col("key_value"), F.concat(F.lit("row "), (F.col("row_pos") + 1).cast("string")))
    stmt = F.concat(F.lit("The "), F.col("column"), F.lit(" of "), subject, F.lit(" is "),
                    T.py_strip("value"), F.lit("."))
    return body.select(*table_cols, *carry, "row_pos", "col_pos", stmt.alias("statement"))


def unroll_named_tables(tables: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Each named table unrolled into its own category.

    ``tables(key, table_name, headers)``, ``rows(key, table_name, row_pos, cells)``
    with F6 cell structs.  Categories keep the original table name and add
    the F8 folder name and the F7 display name.
    """
    category = T.safe_table_name("table_name")
    # names are made once a table, not once a statement
    usable = tables.filter(F.size("headers") > 0).select(key, "table_name", "headers", category.alias("category"),
                                                         T.category_display_name(category).alias("display_name"))
    r = rows.join(usable, [key, "table_name"])
    r = r.select(key, "table_name", "category", "display_name", "row_pos", "headers",
                 F.transform("cells", lambda c: F.when(c.isNull(), F.lit(None).cast("string"))
                             .otherwise(T.cell_text(c))).alias("values"))
    out = unroll_rows(r, [key, "table_name"], carry=("category", "display_name"))
    return out.select(key, "table_name", "category", "display_name", "row_pos", "col_pos", "statement")


# A6 / A7 ------------------------------------------------------------------------------------
def table_format(table_json) -> Column:
    """Per record: ``pivot`` ({columns, data}), ``multi`` (a value with
    headers and rows), else null."""
    t = F.col(table_json) if isinstance(table_json, str) else table_json
    keys = F.json_object_keys(t)
    pivot = F.array_contains(keys, "columns") & F.array_contains(keys, "data")
    vals = F.map_values(F.from_json(t, "map<string,string>"))
    multi = F.exists(vals, lambda v: F.coalesce(
        F.array_contains(F.json_object_keys(v), "headers") & F.array_contains(F.json_object_keys(v), "rows"),
        F.lit(False)))
    return F.when(F.coalesce(pivot, F.lit(False)), F.lit("pivot")).when(F.coalesce(multi, F.lit(False)), F.lit("multi"))


def dataset_format(records: DataFrame, order_col: str, table_json: str) -> DataFrame:
    """The format of the first record (by ``order_col``) that has one, else ``unknown``."""
    f = records.select(order_col, table_format(table_json).alias("fmt"))
    return f.agg(
        F.coalesce(F.min_by(F.col("fmt"), F.when(F.col("fmt").isNotNull(), F.col(order_col))),
                   F.lit("unknown")).alias("format"),
        F.count(F.when(F.col("fmt") == "pivot", 1)).cast("bigint").alias("n_pivot"),
        F.count(F.when(F.col("fmt") == "multi", 1)).cast("bigint").alias("n_multi"),
        F.count(F.when(F.col("fmt").isNull(), 1)).cast("bigint").alias("n_unknown"))


def usable_table_names(tables: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Distinct names of tables with headers and at least one row, sorted."""
    with_rows = rows.select(key, "table_name").distinct()
    t = tables.filter(F.size("headers") > 0).join(with_rows, [key, "table_name"], "left_semi")
    return t.select("table_name").distinct().orderBy("table_name")


# G6 ------------------------------------------------------------------------------------------
SENTENCE_SPLIT = r"(?<=[.!?])\s+"


def split_statements(text) -> Column:
    """G6 baseline: lines, then sentences ending in . ! ? before a blank;
    trimmed, empty dropped, exact repeats within the record dropped (first kept)."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.flatten(F.transform(T.py_lines(t), lambda ln: F.split(ln, SENTENCE_SPLIT, -1)))
    return F.array_distinct(F.filter(F.transform(parts, T.py_strip), lambda x: x != ""))
