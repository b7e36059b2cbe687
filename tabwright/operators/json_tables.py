"""Tables inside JSON records, and their unrolling within the record.

Records are Variants, as the JSONL source reads them.  A pivot table is an object
``{"columns": [{"name"}], "data": [[cell]]}``, named tables an object
``{name: {"headers": [..], "rows": [[cell]]}}``.  Tables that are null, no object, or
without columns or rows give nothing (P8).  Everything about one table is array
code inside its row, key column and sentences too, so no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_CELLS = "array<variant>"


def _at(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def cell_text(v: Column) -> Column:
    """A JSON cell as Python prints it: ``True``, ``2.0``; null for null.

    Lists and objects are JSON text.
    """
    kind, text = F.schema_of_variant(v), _at(v, "$", "string")
    return (F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), F.concat(text, F.lit(".0")))
            .otherwise(text))


def _texts(cells: Column) -> Column:
    return F.transform(cells, cell_text)


def _rows(data: Column) -> Column:
    return F.transform(data, lambda r: F.coalesce(_texts(_at(r, "$", _CELLS)), F.array().cast("array<string>")))


def _usable(df: DataFrame) -> DataFrame:
    """Tables with columns and rows."""
    return df.filter((F.size("headers") > 0) & (F.size("rows") > 0))


def pivot_tables(records: DataFrame, field: str = "table", record_col: str = "record") -> DataFrame:
    """The records that hold a usable pivot table, with ``headers`` and ``rows`` (cells as text, nulls kept).

    A column without a name is ``''``.
    """
    t = records.withColumn("_t", _at(F.col(record_col), f"$.{field}", "variant"))
    headers = F.transform(_at(F.col("_t"), "$.columns", _CELLS), lambda c: F.coalesce(_at(c, "$.name", "string"), F.lit("")))
    return _usable(t.withColumns({"headers": headers, "rows": _rows(_at(F.col("_t"), "$.data", _CELLS))}).drop("_t"))


def named_tables(records: DataFrame, field: str = "tables", record_col: str = "record") -> DataFrame:
    """One row per usable named table: the record's columns, ``table_name``, ``headers``, ``rows``, ``category``.

    ``category`` is the F8 folder name.  Only the record's own tables are spread over rows.
    """
    entries = F.map_entries(_at(F.col(record_col), f"$.{field}", "map<string,variant>"))
    t = records.select("*", F.explode(entries).alias("_e"))
    # the sizes that P8 asks for are those of the lists as they stand: no cell is made text to be counted
    t = _usable(t.withColumns({"table_name": F.col("_e.key"), "headers": _at(F.col("_e.value"), "$.headers", _CELLS),
                               "rows": _at(F.col("_e.value"), "$.rows", _CELLS)}))
    return t.withColumns({"headers": _texts(F.col("headers")), "rows": _rows(F.col("rows")),
                          "category": T.safe_table_name("table_name")}).drop("_e")


def table_names(records: DataFrame, field: str = "tables", record_col: str = "record") -> DataFrame:
    """Distinct names of usable tables, sorted; combined map-side before the one shuffle of names."""
    return named_tables(records.select(record_col), field, record_col).select("table_name").distinct().orderBy("table_name")


def table_kind(records: DataFrame, field: str, record_col: str = "record", out_col: str = "format") -> DataFrame:
    """A6 per record: ``pivot``, ``multi`` or null, from the fields that the table object has."""
    t = records.withColumn("_m", _at(F.col(record_col), f"$.{field}", "map<string,variant>"))
    has = lambda m, k: F.coalesce(F.array_contains(F.map_keys(m), k), F.lit(False))
    multi = F.exists(F.map_values("_m"), lambda v: has(_at(v, "$", "map<string,variant>"), "headers")
                     & has(_at(v, "$", "map<string,variant>"), "rows"))
    pivot = has(F.col("_m"), "columns") & has(F.col("_m"), "data")
    return t.withColumn(out_col, F.when(pivot, "pivot").when(F.coalesce(multi, F.lit(False)), "multi")).drop("_m")


def with_key_column(tables: DataFrame, headers_col: str = "headers", rows_col: str = "rows", out_col: str = "key_pos",
                    na_token: str = "") -> DataFrame:
    """A10 within the record: position of the first column without missing and repeated values, or null."""
    rows = F.col(rows_col)

    def is_key(i: Column) -> Column:
        values = F.transform(rows, lambda r: F.get(r, i))
        return (F.size(F.array_distinct(values)) == F.size(values)) & ~F.exists(values, lambda v: T.is_missing(v, na_token))

    places = F.transform(F.col(headers_col), lambda _, i: i)
    return tables.withColumn(out_col, F.array_min(F.filter(places, is_key)))


def with_statements(tables: DataFrame, headers_col: str = "headers", rows_col: str = "rows", out_col: str = "statements",
                    na_token: str = "") -> DataFrame:
    """G4 within the record: ``The <column> of <key> is <value>.`` for each non-key, non-missing cell, row by row.

    ``out_col`` holds (row_pos, col_pos, statement).  Without a key column the subject is ``row <n>``.
    """
    t = with_key_column(tables, headers_col, rows_col, "_key", na_token)
    key = F.col("_key")

    def sentences(row: Column, i: Column) -> Column:
        subject = F.coalesce(T.py_strip(F.get(row, key)), F.concat(F.lit("row "), (i + 1).cast("string")))

        def sentence(name: Column, j: Column) -> Column:
            value = F.get(row, j)
            told = (key.isNull() | (j != key)) & ~T.is_missing(value, na_token)
            text = F.concat(F.lit("The "), name, F.lit(" of "), subject, F.lit(" is "), T.py_strip(value), F.lit("."))
            return F.when(told, F.struct(i.alias("row_pos"), j.alias("col_pos"), text.alias("statement")))
        return F.filter(F.transform(F.col(headers_col), sentence), lambda s: s.isNotNull())

    return t.withColumn(out_col, F.flatten(F.transform(F.col(rows_col), sentences))).drop("_key")
