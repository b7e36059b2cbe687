"""Schema and column induction (A1-A10).

Type inference over a wide table is *one* aggregation pass with five
counters per column; the single result row is then unpivoted.  The input is
never unpivoted, so the scan stays columnar and the shuffle is one row per
map task.  Enum discovery needs per-value groups, so it stacks the chosen
columns and relies on map-side partial aggregation; only columns with at
most 10 distinct values are ever collected, so no unbounded list forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import constants as K
from ..functions import text as T


def _cells(df: DataFrame, columns: list[str] | None, as_text: dict | None = None) -> list[tuple[str, Column]]:
    cols = columns or df.columns
    as_text = as_text or {}
    return [(c, as_text.get(c, F.col(c).cast("string"))) for c in cols]


def _type_flag_aggs(v: Column, prefix: str, na_token: str = "", dtype: TY.DataType | None = None) -> list[Column]:
    """Counters of rows, missing values, and present values that are no boolean / integer / date / number.

    ``dtype`` is the column's own type where its text is its plain cast: integers and
    floating numbers are then judged by value, and only floats that print with an
    exponent by their text.
    """
    if isinstance(dtype, TY.IntegralType) and not na_token:
        present = v.isNotNull()
        flags = [~v.isin(0, 1), F.lit(False), ~v.between(1000, 9999), F.lit(False)]
        missing = v.isNull()
    elif isinstance(dtype, (TY.DoubleType, TY.FloatType)) and not na_token:
        text, size = v.cast("string"), F.abs(v)
        plain = (v == 0) | ((size >= 1e-3) & (size < 1e7))         # prints as digits, a point and digits
        present, missing = v.isNotNull(), v.isNull()
        flags = [F.lit(True), F.lit(True), F.lit(True), F.when(plain, F.lit(False)).otherwise(~T.is_number_text(text))]
    else:
        v = v.cast("string")
        missing = T.is_missing(v, na_token)
        present = ~missing
        flags = [~T.is_bool_text(v), ~T.is_int_text(v), ~T.is_date_text(v), ~T.is_number_text(v)]
    return [F.count(F.lit(1)).alias(f"{prefix}n"), F.count_if(missing).alias(f"{prefix}miss"),
            *[F.count_if(present & no).alias(prefix + k) for k, no in zip(("nb", "ni", "nd", "nn"), flags)]]


def _type_from_flags(prefix: str) -> tuple[Column, Column]:
    c = lambda s: F.col(prefix + s)
    present = c("n") - c("miss")
    typ = (F.when(present == 0, "string")
           .when(c("nb") == 0, "boolean")
           .when(c("ni") == 0, "integer")
           .when(c("nd") == 0, "date")
           .when(c("nn") == 0, "number")
           .otherwise("string"))
    # Required when present in every record (and at least one record).
    required = (c("n") > 0) & (c("miss") == 0)
    return typ, required


def infer_column_types(df: DataFrame, columns: list[str] | None = None, na_token: str = "",
                       as_text: dict | None = None) -> DataFrame:
    """A1 + A8 + A9 (date part) over every column of a wide table.

    Returns ``(column_name, position, type, format, pattern, required,
    n_missing, n_values)``.  ``as_text`` maps a column to the text form to
    judge (default: cast to string).
    """
    cells = _cells(df, columns, as_text)
    aggs = []
    for i, (name, v) in enumerate(cells):
        own = name not in (as_text or {})
        aggs += _type_flag_aggs(F.col(name) if own else v, f"c{i}_", na_token, df.schema[name].dataType if own else None)
    row = df.agg(*aggs)
    structs = []
    for i, (name, _) in enumerate(cells):
        typ, req = _type_from_flags(f"c{i}_")
        structs.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(i).alias("position"), typ.alias("type"),
            F.when(typ == "date", F.lit(K.DATE_FORMAT)).alias("format"),
            F.when(typ == "date", F.lit(K.DATE_PATTERN)).alias("pattern"),
            req.alias("required"),
            F.col(f"c{i}_miss").cast("bigint").alias("n_missing"),
            F.col(f"c{i}_n").cast("bigint").alias("n_values")))
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def infer_types_long(cells: DataFrame, group_cols: list[str], value_col: str = "value",
                     na_token: str = "") -> DataFrame:
    """A1 + A8 over long-form cells, one result per group (e.g. record x column)."""
    agg = cells.groupBy(*group_cols).agg(*_type_flag_aggs(F.col(value_col), "_", na_token))
    typ, req = _type_from_flags("_")
    return agg.select(*group_cols, typ.alias("type"),
                      F.when(typ == "date", F.lit(K.DATE_FORMAT)).alias("format"),
                      req.alias("required"))


# A2 / A9 ----------------------------------------------------------------------
def stack_cells(df: DataFrame, pos: Column, columns: list[str], as_text: dict | None = None) -> DataFrame:
    """Long form ``(pos, column_name, value)`` of the chosen columns."""
    cells = _cells(df, columns, as_text)
    arr = F.array(*[F.struct(F.lit(n).alias("column_name"), v.alias("value")) for n, v in cells])
    return df.select(pos.alias("pos"), F.explode(arr).alias("c")).select("pos", "c.column_name", "c.value")


def small_enums(cells: DataFrame, group_cols: list[str], value_col: str = "value", pos_col: str = "pos",
                na_token: str = "", min_size: int = 2, max_size: int = 10, count_all: bool = False) -> DataFrame:
    """A2: case-folded distinct non-missing values; enum when 2..10 of them.

    The first spelling (smallest ``pos``) of each folded value is kept and the
    list is in order of first appearance.  Returns ``(group..., n_distinct,
    enum_values ARRAY<STRING> or null)``; ``n_distinct`` is null beyond ``max_size``.

    A sketch of fixed size per group (one scan, merged map-side) rules out groups
    with far more values, so the values of such columns are never shuffled; the
    others leave a task as a few partial sums.  Sketches count small sets exactly
    but for chance of about 1e-9, and a group is ruled out only at four times the size.
    With ``count_all`` every group's distinct values are counted exactly.

    Rows are first combined by their text as it stands, with a number as the only
    buffer: that is a hash aggregation, which holds the distinct texts of a task and
    sorts no rows.  Stripping and folding then see distinct texts alone.
    """
    each = cells.groupBy(*group_cols, F.col(value_col).alias("_raw")).agg(F.min(pos_col).alias("_pos"))
    if not count_all:
        text = F.when(~T.is_missing(F.col(value_col), na_token), F.lower(T.py_strip(F.col(value_col))))
        sketch = cells.groupBy(*group_cols).agg(F.approx_count_distinct(text, 0.02).alias("_about")).filter("_about > 0")
        few = sketch.filter(F.col("_about") <= 4 * max_size).select(*group_cols)
        each = cells.join(few, group_cols, "left_semi").groupBy(*group_cols, F.col(value_col).alias("_raw")).agg(
            F.min(pos_col).alias("_pos"))
    nm = each.filter(~T.is_missing(F.col("_raw"), na_token)).select(*group_cols, "_pos", T.py_strip("_raw").alias("_v"))
    groups = nm.groupBy(*group_cols, F.lower("_v").alias("_k")).agg(
        F.min_by("_v", "_pos").alias("_spelling"), F.min("_pos").alias("_first"))
    if count_all:
        seen = groups.groupBy(*group_cols).agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
        groups = groups.join(seen.filter(F.col("n_distinct") <= max_size).select(*group_cols), group_cols, "left_semi")
    # Only groups of columns that qualify are collected: at most 4 * max_size values each.
    values = groups.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct("_first", "_spelling"))).alias("_e"))
    n = F.size("_e")
    enum = F.when(n.between(min_size, max_size), F.transform("_e", lambda x: x["_spelling"])).alias("enum_values")
    if count_all:
        return seen.join(values.select(*group_cols, enum), group_cols, "left")
    exact = values.select(*group_cols, F.when(n <= max_size, n.cast("bigint")).alias("n_distinct"), enum)
    return sketch.select(*group_cols).join(exact, group_cols, "left")


# A10 ---------------------------------------------------------------------------
#: Columns whose sketch says fewer distinct values than this share of the rows are no keys (ten standard deviations).
KEY_SHARE, SKETCH_ERROR = 0.9, 0.01


def detect_primary_key(df: DataFrame, columns: list[str] | None = None, na_token: str = "",
                       as_text: dict | None = None) -> DataFrame:
    """A10: the leftmost column with no missing value and all values distinct.

    One scan gives the rows, each column's missing values and a distinct-count
    sketch, which rule out all columns but those that look unique.  These are
    checked exactly, leftmost first, until one is a key: a column is none as soon as
    one value turns up twice (values are combined map-side before the shuffle).
    Returns ``(key_column, n_rows)``.
    """
    cells = _cells(df, columns, as_text)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, v) in enumerate(cells):
        aggs += [F.count_if(T.is_missing(v, na_token)).alias(f"m{i}"), F.approx_count_distinct(v, SKETCH_ERROR).alias(f"d{i}")]
    seen = df.agg(*aggs).first()
    key = None
    for i, (name, v) in enumerate(cells):
        if seen[f"m{i}"] or seen[f"d{i}"] < KEY_SHARE * seen["n"] or not seen["n"]:
            continue
        twice = df.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if twice.isEmpty():
            key = name
            break
    return df.sparkSession.createDataFrame([(key, seen["n"])], "key_column string, n_rows bigint").coalesce(1)


# A3 ----------------------------------------------------------------------------
def minimal_schema(example_id, header_names) -> Column:
    """A3: schema object from headers only (all string, not required).

    Returns a struct ``(schema_id, structure, field_names)``; render it with
    :func:`minimal_schema_json`.
    """
    names = F.transform(header_names if isinstance(header_names, Column) else F.col(header_names), T.snake_case)
    uniq = T.unique_names(names)
    structure = T.structure_schema_stage(header_names if isinstance(header_names, Column) else F.col(header_names))
    return F.struct(T.schema_id(example_id, structure, uniq).alias("schema_id"),
                    structure.alias("structure"), uniq.alias("field_names"))


def minimal_schema_json(schema: Column, description: str = "Minimal schema induced from the document.") -> Column:
    fields = F.concat(F.lit("["), F.array_join(F.transform(schema["field_names"], lambda n: T.json_object([
        ("name", T.json_string(n)), ("type", F.lit('"string"')), ("required", F.lit("false"))])), ", "),
        F.lit("]"))
    return T.json_object([("schema_id", T.json_string(schema["schema_id"])),
                          ("structure", T.json_string(schema["structure"])),
                          ("description", T.json_string(F.lit(description))),
                          ("fields", fields)])


# A4 ----------------------------------------------------------------------------
def prompt_schema_json(table_id, names, description: str = "Schema induced from the gold table.") -> Column:
    """A4: ``schema_id`` = table id (default ``auto``), F16 structure, all string, required."""
    n = names if isinstance(names, Column) else F.col(names)
    fields = F.concat(F.lit("["), F.array_join(F.transform(n, lambda x: T.json_object([
        ("name", T.json_string(x)), ("type", F.lit('"string"')), ("required", F.lit("true"))])), ", "),
        F.lit("]"))
    tid = table_id if isinstance(table_id, Column) else F.col(table_id)
    return T.json_object([("schema_id", T.json_string(F.coalesce(tid, F.lit("auto")))),
                          ("structure", T.json_string(T.structure_table_stage(n))),
                          ("description", T.json_string(F.lit(description))),
                          ("fields", fields)])


# A5 ----------------------------------------------------------------------------
def header_schema_fields(headers: DataFrame, key: str = "record_id") -> DataFrame:
    """A5: field list from a multi-table header schema in long form.

    ``headers`` rows: ``(key, table_pos, table_name, header_pos, header)``;
    a table with no headers has one row with a null header.  Fields: one
    ``<table>_name`` per table (required for the first table only), then each
    new F4 name of a column header in table/header order, typed by F17.
    Returns ``(key, schema_id, field_pos, name, type, required)``.
    """
    tables = headers.groupBy(key, "table_pos").agg(F.first("table_name").alias("table_name"))
    tbl_fields = tables.select(
        key, F.concat(F.lower("table_name"), F.lit("_name")).alias("name"),
        F.lit(0).alias("grp"), F.col("table_pos").alias("p1"), F.lit(0).alias("p2"),
        F.lit("string").alias("type"), (F.col("table_pos") == 0).alias("required"))
    hdr = headers.filter(F.col("header").isNotNull()).select(
        key, T.snake_case_plain("header").alias("name"), F.lit(1).alias("grp"),
        F.col("table_pos").alias("p1"), F.col("header_pos").alias("p2"))
    hdr = hdr.filter(F.col("name") != "")
    hdr = hdr.select(*hdr.columns, T.guess_header_type("name").alias("type"), F.lit(False).alias("required"))
    allf = tbl_fields.unionByName(hdr)
    first = allf.groupBy(key, "name").agg(F.min(F.struct("grp", "p1", "p2", "type", "required")).alias("f"))
    sid = tables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("table_pos", "table_name"))).alias("t"))
    sid = sid.select(key, F.concat(F.array_join(F.transform("t", lambda x: F.lower(x["table_name"])), "_"),
                                   F.lit("_schema")).alias("schema_id"))
    return first.join(sid, key).select(
        key, "schema_id", F.col("f.grp").alias("grp"), F.col("f.p1").alias("p1"), F.col("f.p2").alias("p2"),
        "name", F.col("f.type").alias("type"), F.col("f.required").alias("required"))


FIELD = "struct<grp:int,p1:int,p2:int,name:string,type:string,required:boolean>"


def with_schema_fields(df: DataFrame, tables_col: str, out_col: str = "fields") -> DataFrame:
    """A5 within the record: ``schema_id`` and ``out_col`` from an array of (name, headers), without a shuffle.

    The fields are those of :func:`header_schema_fields`, in order of first appearance.
    """
    tables = F.col(tables_col)
    title = F.transform(tables, lambda t: F.lower(t["name"]))

    def field(grp, i, j, name, kind, required):
        parts = [F.lit(grp), i.cast("int"), j, name, kind, required]
        return F.struct(*[c.alias(n) for c, n in zip(parts, ("grp", "p1", "p2", "name", "type", "required"))])

    own = F.transform(title, lambda t, i: field(0, i, F.lit(0), F.concat(t, F.lit("_name")), F.lit("string"), i == 0))
    heads = F.flatten(F.transform(tables, lambda t, i: F.transform(
        F.coalesce(t["headers"], F.array().cast("array<string>")), lambda h, j: T.let(T.snake_case_plain(h), lambda name: field(
            1, i, j.cast("int"), name, T.guess_header_type(name), F.lit(False))))))
    x = df.withColumn("_all", F.filter(F.concat(own, heads).cast(f"array<{FIELD}>"), lambda f: f["name"] != ""))
    first = T.let(F.transform("_all", lambda f: f["name"]), lambda names: F.filter(
        "_all", lambda f, i: F.array_position(names, f["name"]) == i + 1))
    sid = F.concat(F.array_join(title, "_"), F.lit("_schema"))
    return x.withColumns({out_col: first, "schema_id": sid}).drop("_all")


# A8 / A9 combined -------------------------------------------------------------------
def column_constraints(types: DataFrame, enums: DataFrame, key_cols: list[str]) -> DataFrame:
    """Per column the schema field with its constraints.

    ``types`` from :func:`infer_column_types` (or the long form), ``enums``
    from :func:`small_enums`, joined on ``key_cols``.  A date field gets its
    format and pattern; an enum is attached only when A2 found 2-10 values;
    no numeric ranges are inferred.
    """
    e = enums.select(*key_cols, "enum_values")
    return types.join(e, key_cols, "left").select(
        *key_cols, "type", "required", "format", "pattern", "enum_values")
