"""Extraction jobs over model outputs.

Whole-table jobs: a DataFrame of raw outputs in, relations out.  Line-level
parsing is array code inside the row (X1, X2, X4, X6); no step gathers more
than the texts of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import strict_json as SJ
from ..functions import text as T
from . import induce

BIG = 1 << 30


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first_index(arr: Column, pred) -> Column:
    """0-based index of the first element satisfying ``pred``; ``BIG`` if none."""
    return F.array_min(F.transform(arr, lambda x, i: F.when(pred(x), i).otherwise(F.lit(BIG))))


# X1 ---------------------------------------------------------------------------------
# Both parsers stage their intermediate arrays as columns: higher-order
# functions are evaluated per element without common-subexpression
# elimination, so an array used twice must be computed once, in its own
# projection (Catalyst keeps such projections apart).
def with_atomic_statements(df: DataFrame, raw_col: str, out_col: str = "atomic_statements") -> DataFrame:
    """Statements after ``### Atomic Statements:`` up to a ``***`` or
    ``<REASONING STEPS>`` line; without the marker, every non-blank line."""
    raw = F.col(raw_col)
    pos = F.instr(raw, K.ATOMIC_MARKER)
    tail = raw.substr(pos + F.lit(len(K.ATOMIC_MARKER)), F.lit(BIG))
    df = df.withColumn("_x1_has", F.coalesce(pos > 0, F.lit(False)))
    df = df.withColumn("_x1_lines", F.transform(T.py_lines(F.when(F.col("_x1_has"), tail).otherwise(raw)),
                                                T.py_strip))
    stop = _first_index(F.col("_x1_lines"), lambda x: F.startswith(x, F.lit(K.ATOMIC_STOP_PREFIXES[0]))
                        | F.startswith(x, F.lit(K.ATOMIC_STOP_PREFIXES[1])))
    df = df.withColumn("_x1_stop", F.when(F.col("_x1_has"), stop).otherwise(F.lit(BIG)))
    out = F.filter(F.slice("_x1_lines", 1, F.least(F.col("_x1_stop"), F.size("_x1_lines"))), lambda x: x != "")
    return df.withColumn(out_col, out).drop("_x1_has", "_x1_lines", "_x1_stop")


# X2 ---------------------------------------------------------------------------------
def with_numbered_statements(df: DataFrame, text_col: str, out_col: str = "statements") -> DataFrame:
    """Numbered lines of the ``Statements:`` section, which ends at a blank
    line or ``Rows:``; unnumbered or indented lines are skipped."""
    df = df.withColumn("_x2_l", T.py_lines(F.col(text_col)))
    df = df.withColumn("_x2_s", F.transform("_x2_l", T.py_strip))
    df = df.withColumn("_x2_h", _first_index(F.col("_x2_s"), lambda x: F.startswith(x, F.lit(K.STATEMENTS_HEADER))))
    stop = F.array_min(F.transform("_x2_s", lambda x, i: F.when(
        (i > F.col("_x2_h")) & ((x == "") | F.startswith(x, F.lit(K.ROWS_HEADER))), i).otherwise(F.lit(BIG))))
    df = df.withColumn("_x2_stop", stop)

    def pick(x, i):
        inside = (i > F.col("_x2_h")) & (i < F.col("_x2_stop")) \
            & ~F.startswith(F.col("_x2_s")[i], F.lit(K.STATEMENTS_HEADER)) & x.rlike(r"(?dU)^\d+\.")
        return F.when(inside, T.py_strip(F.regexp_extract(x, r"(?dU)^\d+\.\s*(.*)", 1)))

    out = F.filter(F.transform("_x2_l", pick), lambda x: x.isNotNull() & (x != ""))
    return df.withColumn(out_col, out).drop("_x2_l", "_x2_s", "_x2_h", "_x2_stop")


def statements_relation(df: DataFrame, key_cols: list[str], arr: Column) -> DataFrame:
    """Explode a statement array to ``(key..., pos, statement)``."""
    return df.select(*key_cols, F.posexplode(arr).alias("pos", "statement"))


# X3 ---------------------------------------------------------------------------------
_EXPLICIT = r'(?:\A|[\n\r])[\s]*\{"schema"'
NO_OUTPUT, NO_SCHEMA, BROKEN_SCHEMA, EMPTY_SCHEMA = "no output", "no schema", "broken schema JSON", "empty schema"


def schema_outcomes(df: DataFrame, key: str, raw_col: str) -> DataFrame:
    """X3, every input row once: ``(key, kind, schema_json, reason)``.

    ``kind`` is ``explicit`` where a line begins with ``{"schema"`` and a JSON object
    stands there with nothing behind it on its last line (the first such line
    counts); else ``final`` where an object follows ``### Final Schema:``, read
    after missing commas between entries are put in; else ``rejected`` with a reason.
    """
    raw = F.col(raw_col)
    starts = F.slice(F.split(raw, "(?=" + _EXPLICIT + ")", -1), 1, 1 << 30)
    starts = F.filter(starts, lambda t: t.rlike(r"\A[\s]*\{\"schema\""))
    pos = F.instr(raw, K.FINAL_SCHEMA_MARKER)
    block = F.when(pos > 0, raw.substr(pos + F.lit(len(K.FINAL_SCHEMA_MARKER)), F.lit(BIG)))
    block = F.regexp_replace(block, r'\}\s*\n\s*"', '},\n    "')
    x = df.select(key, raw.isNull().alias("_none"), (F.size(starts) > 0).alias("_tried"), pos.alias("_pos"),
                  SJ.json_values(starts).alias("_e"), SJ.json_values(F.array(block)).alias("_f"))
    whole = F.filter("_e", lambda v: v.isNotNull() & (T.py_strip(v["rest"]) == ""))
    x = x.withColumn("_ej", F.get(whole, F.lit(0))["json"]).withColumn("_fj", F.get("_f", F.lit(0))["json"])
    full = F.coalesce(F.size(F.json_object_keys("_fj")) > 0, F.lit(False))
    kind = F.when(F.col("_ej").isNotNull(), "explicit").when(full, "final").otherwise("rejected")
    reason = (F.when(F.col("_none"), NO_OUTPUT).when(F.col("_fj").isNotNull(), EMPTY_SCHEMA)
              .when((F.coalesce(F.col("_pos"), F.lit(0)) > 0) | F.col("_tried"), BROKEN_SCHEMA).otherwise(NO_SCHEMA))
    return x.select(key, kind.alias("kind"), F.when(F.col("_ej").isNotNull(), F.col("_ej")).when(full, F.col("_fj"))
                    .alias("schema_json"), F.when(F.col("_ej").isNull() & ~full, reason).alias("reason"))


def final_schema_tables(outcomes: DataFrame, key: str) -> DataFrame:
    """``(key, tables)`` of ``final`` outcomes: (name, headers) of each table, in the object's order.

    Headers are the text elements of ``column_headers``, or of ``col_headers`` where
    that is missing or empty; null where a table has neither.
    """
    x = outcomes.filter(F.col("kind") == "final").select(
        key, F.json_object_keys("schema_json").alias("_k"), F.from_json("schema_json", "map<string,string>").alias("_m"))

    def texts(entry, name):
        return T.let(F.try_variant_get(entry, f"$.{name}", "array<variant>"), lambda found: F.when(F.size(found) > 0, F.transform(
            F.filter(found, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))))

    def table(entries, name):
        return T.let(F.try_parse_json(F.element_at(entries, name)), lambda entry: F.struct(
            name.alias("name"), F.coalesce(texts(entry, "column_headers"), texts(entry, "col_headers")).alias("headers")))
    return x.select(key, T.let(F.col("_m"), lambda m: F.transform("_k", lambda name: table(m, name))).alias("tables"))


def final_schema_headers(outcomes: DataFrame, key: str) -> DataFrame:
    """The headers of :func:`final_schema_tables` in long form; a table without any has one row with a null header."""
    x = final_schema_tables(outcomes, key).select(key, F.posexplode("tables").alias("table_pos", "t"))
    return x.select(key, "table_pos", F.col("t.name").alias("table_name"),
                    F.posexplode_outer("t.headers").alias("header_pos", "header"))


def parse_schema_outputs(df: DataFrame, key: str, raw_col: str) -> tuple[DataFrame, DataFrame]:
    """X3 + A5: ``(explicit, fields)``.

    ``explicit`` holds records whose output carried a ``{"schema"...}`` line
    (its JSON text); ``fields`` holds the A5 field list built from the
    ``### Final Schema:`` block of the others, one row per field, made within the
    record.  :func:`schema_outcomes` has the rest.
    """
    out = schema_outcomes(df, key, raw_col)
    explicit = out.filter(F.col("kind") == "explicit").select(key, "schema_json")
    made = induce.with_schema_fields(final_schema_tables(out, key), "tables")
    # an inner explode of a column adds a filter on its size, which Spark pushes through all projections down to the
    # JSON parser with every expression written out anew
    each = made.select(key, "schema_id", F.explode_outer("fields").alias("f")).filter(F.col("f").isNotNull())
    return explicit, each.select(key, "schema_id", "f.*")


SCHEMA_OBJECT = ("struct<schema_id:string,structure:string,"
                 "fields:array<struct<name:string,type:string,required:boolean>>>")


def schema_objects(explicit: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Per record the schema object of stage 2: the explicit ``{"schema": ...}``
    when given, else ``(schema_id, "object", fields)`` from the A5 field list.
    Fields per record are bounded by that record's headers."""
    built = fields.groupBy(key).agg(
        F.first("schema_id").alias("schema_id"),
        F.sort_array(F.collect_list(F.struct("grp", "p1", "p2", "name", "type", "required"))).alias("f"))
    built = built.select(key, F.struct(
        F.col("schema_id"), F.lit("object").alias("structure"),
        F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"),
                                            x["required"].alias("required"))).alias("fields")).alias("schema"))
    exp = explicit.select(key, F.from_json("schema_json", "struct<schema:" + SCHEMA_OBJECT + ">")["schema"]
                          .alias("schema"))
    return exp.unionByName(built)


# X4 ---------------------------------------------------------------------------------
NO_TABLES, NO_TABLE = "no tables section", "no table with a name and headers"


def parse_markdown_tables_long(df: DataFrame, key: str, raw_col: str, with_rejects: bool = False) -> DataFrame:
    """Named tables under ``### Final Output Tables``, one row per table line.

    Returns ``(key, table_pos, table_name, kind, row_pos, headers, cells)``:
    ``kind`` is ``header`` (with ``headers``) or ``row`` (with ``row_pos``
    and F6 ``cells``).
    A later section with the same name replaces the earlier one but keeps
    its position; blank cells are dropped before alignment.  ``with_rejects``
    adds a row of kind ``reject`` with ``reason`` for every record without a
    table, so each key is either there with tables or rejected.

    A record's text is parsed by array code within its row, linear in its lines but for
    two sorts of its sections, and its table lines are exploded last: no line is shuffled
    or sorted, so a task holds texts, not the lines of all its records.  The texts of a key
    that comes more than once are read together, line by line.
    """
    texts = df.groupBy(key).agg(F.collect_list(F.struct(F.col(raw_col).alias("raw"))).alias("_raws"))

    def numbered(raw):
        return F.transform(T.py_lines(raw), lambda x, i: F.struct(i.alias("pos"), T.py_strip(x).alias("line")))
    lines = F.when(F.size("_raws") == 1, numbered(F.get("_raws", F.lit(0))["raw"])).otherwise(
        F.sort_array(F.flatten(F.transform("_raws", lambda r: numbered(r["raw"])))))
    x = texts.select(key, "_raws", lines.alias("_lines"))
    markers = F.filter("_lines", lambda x: F.startswith(x["line"], F.lit(K.FINAL_TABLES_MARKER)))
    x = x.withColumn("_start", F.get(markers, F.lit(0))["pos"])
    x = x.withColumn("_body", T.let(F.col("_start"), lambda start: F.filter("_lines", lambda x: x["pos"] > start)))

    def filled(x):
        cells = F.filter(F.transform(F.split(x["line"], r"\|", -1), T.py_strip), lambda c: c != "")
        return F.struct(x["pos"].alias("pos"), cells.alias("cells"))

    def section(body, at, until):
        rows = F.filter(F.slice(body, at + 2, until - at - 1), lambda x: F.contains(x["line"], F.lit("|")))
        name = T.py_strip(F.regexp_replace(F.get(body, at)["line"], "^#+", ""))
        return F.struct(name.alias("name"), at.alias("at"),
                        F.filter(F.transform(rows, filled), lambda r: F.size(r["cells"]) > 0).alias("rows"))

    def sections(body):
        heads = F.filter(F.transform(body, lambda x, i: F.when(F.startswith(x["line"], F.lit("### ")), i)), lambda i: i.isNotNull())
        return T.let(heads, lambda h: F.transform(h, lambda at, k: section(
            body, at, F.coalesce(F.get(h, k + 1), F.size(body)))))

    def tables(found):      # by name: the place of its first section with the lines of its last
        first = F.filter(found, lambda s, i: (i == 0) | (F.get(found, i - 1)["name"] != s["name"]))
        last = F.filter(found, lambda s, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["name"] != s["name"]))
        return F.sort_array(F.zip_with(first, last, lambda f, t: F.struct(f["at"].alias("at"), t["name"].alias("name"), t["rows"].alias("rows"))))

    # a section counts when it has a non-empty name and a header line
    usable = F.filter(T.let(F.col("_body"), sections), lambda s: (s["name"] != "") & (F.size(s["rows"]) > 0))
    x = x.withColumn("_tables", T.let(F.sort_array(usable), tables))
    parts = ("table_pos", "table_name", "kind", "row_pos", "headers", "cells", "reason")

    def line_of(t, place, r, i):
        is_head = r["pos"] == F.get(t["rows"], F.lit(0))["pos"]
        own = [place, t["name"], F.when(is_head, "header").otherwise("row"), F.when(~is_head, i - 1), F.when(is_head, r["cells"]),
               F.when(~is_head, F.transform(r["cells"], T.convert_cell)), F.lit(None).cast("string")]
        return F.struct(*[c.alias(n) for c, n in zip(own, parts)])
    out = F.flatten(F.transform("_tables", lambda t, p: F.transform(t["rows"], lambda r, i: line_of(t, p, r, i))))
    if with_rejects:
        def reject(r):
            reason = F.when(r["raw"].isNull(), NO_OUTPUT).when(F.col("_start").isNull(), NO_TABLES).otherwise(NO_TABLE)
            none = ("int", "string", "string", "int", "array<string>", f"array<{T.CELL_TYPE}>", "string")
            own = [F.lit("reject") if n == "kind" else reason if n == "reason" else F.lit(None).cast(t) for n, t in zip(parts, none)]
            return F.struct(*[c.alias(n) for c, n in zip(own, parts)])
        out = F.when(F.size("_tables") > 0, out).otherwise(F.transform("_raws", reject))
    long = x.select(key, F.explode_outer(out).alias("_l")).filter(F.col("_l").isNotNull()).select(key, "_l.*")
    return long if with_rejects else long.drop("reason")


def parse_markdown_tables(df: DataFrame, key: str, raw_col: str) -> tuple[DataFrame, DataFrame]:
    """X4 as two relations: ``tables(key, table_pos, table_name, headers)`` and
    ``rows(key, table_name, row_pos, cells)``.  Both are filters of
    :func:`parse_markdown_tables_long`; a consumer that needs both in one
    result should aggregate the long form instead, which parses once."""
    p = parse_markdown_tables_long(df, key, raw_col)
    tables = p.filter(F.col("kind") == "header").select(key, "table_pos", "table_name", "headers")
    rows = p.filter(F.col("kind") == "row").select(key, "table_name", "row_pos", "cells")
    return tables, rows


# X5 / X7 ------------------------------------------------------------------------------
SCHEMA_FIELDS = "struct<fields:array<struct<name:string,type:string>>>"


def first_user_turn(messages) -> Column:
    """Content of the first ``user`` turn ('' when none)."""
    users = F.filter(_c(messages), lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(users, F.lit(1))["content"], F.lit(""))


def schema_from_user_turn(user_text) -> Column:
    """The ``[SCHEMA]`` JSON before ``<|document|>`` as (fields[name, type])."""
    payload = F.regexp_extract(_c(user_text), r"(?s)\[SCHEMA\]\n(.*?)\n\s*<\|document\|>", 1)
    return F.from_json(T.py_strip(payload), SCHEMA_FIELDS)


# X6 ------------------------------------------------------------------------------------
def ndjson_rows(generation) -> Column:
    """Non-blank lines of an NDJSON output with a strict parse verdict each."""
    lines = F.filter(T.py_lines(_c(generation)), lambda x: T.py_strip(x) != "")
    return SJ.parse_json_lines(lines)
