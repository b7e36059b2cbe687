"""Training-row and prompt builders.

Every builder is a column expression over one record, so building rows is a
single narrow stage (no shuffle); constants are literals folded by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import prompts as PR
from ..functions import text as T
from . import induce


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def turn(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).cast("string").alias("content"))


def dropout_draw(seed: int, record_id, key: str) -> Column:
    """M3 draw: a uniform in [0, 1) from the first 13 hex digits of
    md5("seed|record|key"); the same on any engine and any partitioning."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), _c(record_id).cast("string"), F.lit(key)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def keep_key(seed: int, record_id, key: str, p: float) -> Column:
    """Keep a metadata key when its draw is at least ``p``."""
    return dropout_draw(seed, record_id, key) >= F.lit(p)


# M2 / M3 ----------------------------------------------------------------------
def metadata_json(document, language: str = "en", na_token: str = "", source_modality: str = "plain_text",
                  dropout: float = 0.0, seed: int = 0, record_id=None) -> Column:
    """M2 metadata object as JSON text; with ``dropout`` > 0 each key but the
    two kept ones is dropped when its (seed, record, key) draw is below p."""
    static = PR.metadata_static_values(language, na_token, source_modality)
    frags = []
    for k in PR.METADATA_KEYS:
        v = (F.coalesce(F.length(_c(document)), F.lit(0)).cast("string") if k == "document_char_len"
             else F.lit(static[k]))
        frag = F.concat(F.lit(PR.dumps(k) + ": "), v)
        if dropout > 0 and k not in K.DROPOUT_KEEP_KEYS:
            frag = F.when(keep_key(seed, record_id if record_id is not None else document, k, dropout), frag)
        frags.append(frag)
    return F.concat(F.lit("{"), F.concat_ws(", ", *frags), F.lit("}"))


# M4 / M5 ----------------------------------------------------------------------
def schema_user_content(document, policy_lines: list[str] | None = None, system_prompt: str = PR.SCHEMA_SYSTEM,
                        **md_kwargs) -> Column:
    """M4: tagged policy, metadata, document and task blocks."""
    policy = PR.policy_block(policy_lines if policy_lines is not None else PR.SCHEMA_POLICY_LINES)
    return F.concat(
        F.lit("<|policy|>\n" + policy + "\n\n<|metadata|>\n[METADATA]\n"),
        metadata_json(document, **md_kwargs),
        F.lit("\n\n<|document|>\n[DOCUMENT]\n"), F.coalesce(_c(document), F.lit("")),
        F.lit("\n\n<|task|>\n[TASK]\n" + system_prompt))


def schema_stage_rows(records: DataFrame, id_col: str = "id", text_col: str = "text",
                      names_col: str = "column_names", system_prompt: str = PR.SCHEMA_SYSTEM,
                      policy_lines: list[str] | None = None, **md_kwargs) -> DataFrame:
    """M5 (with P1): ``messages`` = system, user (M4), assistant (A3 JSON).

    Records with blank text or no columns are skipped; the text is trimmed.
    """
    text = T.py_strip(F.coalesce(F.col(text_col), F.lit("")))
    kept = records.filter((text != "") & (F.coalesce(F.size(names_col), F.lit(0)) > 0))
    kept = kept.withColumn("_text", T.py_strip(F.col(text_col)))
    if "record_id" not in md_kwargs:
        md_kwargs["record_id"] = F.col(id_col)
    schema = induce.minimal_schema(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(names_col))
    msgs = F.array(turn("system", F.lit(system_prompt)),
                   turn("user", schema_user_content(F.col("_text"), policy_lines, system_prompt, **md_kwargs)),
                   turn("assistant", induce.minimal_schema_json(schema)))
    return kept.select(F.col(id_col), msgs.alias("messages"), schema["schema_id"].alias("schema_id"))


# M6 / M7 / M8 ----------------------------------------------------------------
def table_user_content(document, schema_json, policy: str = PR.TABLE_POLICY,
                       output_format: str = PR.TABLE_OUTPUT_FORMAT, task: str = PR.TABLE_TASK) -> Column:
    """M6: policy, ``[SCHEMA]`` JSON, the document marker, document, format, task."""
    return F.concat(F.lit(policy + "\n\n[SCHEMA]\n"), _c(schema_json),
                    F.lit("\n\n<|document|>\n\n[DOCUMENT]\n"), F.coalesce(_c(document), F.lit("")),
                    F.lit("\n\n" + output_format + "\n\n" + task))


def render_ndjson(schema_names, table_names, rows) -> Column:
    """M7: each row re-ordered to the schema columns as one JSON object per line.

    A schema column absent from the table, beyond a short row, or null gives
    ``""``; other values are trimmed text.
    """
    sn = _c(schema_names)

    def place(names, k):
        # the last table column of that name wins, as a name -> index lookup built in order does
        back = F.array_position(names, k)
        return F.when(back > 0, (F.size(names) - back + 1).cast("int"))

    def line(r, places, heads):
        values = F.transform(places, lambda i: F.coalesce(T.py_strip(F.try_element_at(r, i)), F.lit("")))
        pairs = F.transform(values, lambda v, j: F.concat(F.get(heads, j), T.json_string(v)))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    # a record's places and names are worked out once, not for each of its rows
    places = T.let(F.reverse(_c(table_names)), lambda names: F.transform(sn, lambda k: place(names, k)))
    heads = F.transform(sn, lambda k: F.concat(T.json_string(k), F.lit(": ")))
    return T.let(places, lambda p: T.let(heads, lambda h: F.array_join(
        F.transform(_c(rows), lambda r: line(r, p, h)), "\n")))


def table_stage_rows(records: DataFrame, id_col: str = "id", text_col: str = "text",
                     table_id_col: str = "table_id", schema_names_col: str = "schema_names",
                     table_names_col: str = "table_names", rows_col: str = "rows", split_col: str = "split",
                     system_prompt: str = PR.TABLE_SYSTEM) -> DataFrame:
    """M8: ``(id, messages, metadata{table_id, split})`` per validated record."""
    schema_json = induce.prompt_schema_json(F.col(table_id_col), F.col(schema_names_col))
    msgs = F.array(turn("system", F.lit(system_prompt)),
                   turn("user", table_user_content(F.col(text_col), schema_json)),
                   turn("assistant", render_ndjson(schema_names_col, table_names_col, rows_col)))
    md = F.struct(F.col(table_id_col).alias("table_id"), F.col(split_col).cast("string").alias("split"))
    return records.select(F.col(id_col).alias("id"), msgs.alias("messages"), md.alias("metadata"),
                          schema_json.alias("prompt_schema"))


# M9 - M13 ---------------------------------------------------------------------
def statement_prompt(text, system_prompt: str = PR.STATEMENT_SYSTEM) -> Column:
    """M9: statement-extraction chat."""
    return F.array(turn("system", F.lit(system_prompt)),
                   turn("user", F.concat(F.lit(PR.STATEMENT_USER_PREFIX), _c(text), F.lit("\n"))))


def schema_prompt(statements, system_prompt: str = PR.SCHEMA_FROM_STATEMENTS_SYSTEM) -> Column:
    """Schema-inference chat over numbered statements."""
    user = F.concat(F.lit(PR.SCHEMA_USER_HEAD), T.number_lines(statements), F.lit(PR.SCHEMA_USER_TAIL))
    return F.array(turn("system", F.lit(system_prompt)), turn("user", user))


def table_prompt(statements, schema_text, system_prompt: str = PR.TABLE_FROM_STATEMENTS_SYSTEM,
                 control: str = PR.TABLE_FROM_STATEMENTS_CONTROL) -> Column:
    """Table-filling chat, two system turns, statements + schema text."""
    schema_block = F.coalesce(T.py_strip(_c(schema_text)), F.lit(""))
    user = F.concat(F.lit(PR.TABLE_USER_HEAD), T.number_lines(statements), F.lit(PR.TABLE_USER_MID),
                    schema_block, F.lit(PR.TABLE_USER_TAIL))
    return F.array(turn("system", F.lit(system_prompt)), turn("system", F.lit(control)), turn("user", user))


def table_to_markdown(headers, rows) -> Column:
    """``|h1|h2|`` then one ``|c1|c2|`` line per row; null -> ``None``."""
    head = F.concat(F.lit("|"), F.array_join(_c(headers), "|"), F.lit("|"))
    body = F.array_join(F.transform(_c(rows), lambda r: F.concat(
        F.lit("|"), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("None"))), "|"), F.lit("|"))), "\n")
    return F.concat(head, F.lit("\n"), body)


def unroll_prompt(markdown, system_prompt: str = PR.UNROLL_SYSTEM, control: str = PR.UNROLL_CONTROL) -> Column:
    """Table-unroll chat."""
    return F.array(turn("system", F.lit(system_prompt)), turn("system", F.lit(control)),
                   turn("user", F.concat(F.lit(PR.UNROLL_USER_PREFIX), _c(markdown))))


# Merged examples -> stage rows ------------------------------------------------------
def schema_stage_from_examples(examples: DataFrame, **kwargs) -> DataFrame:
    """M5 over merged examples: header names from ``schema.columns``."""
    from .validate import column_names
    x = examples.withColumn("column_names", F.when(F.col("schema").isNotNull(), column_names("schema.columns")))
    return schema_stage_rows(x, id_col="id", text_col="text", names_col="column_names", **kwargs)


def table_stage_from_examples(examples: DataFrame, **kwargs) -> DataFrame:
    """M8 over merged examples that passed P2: schema and table column names
    (P7), the table id of the schema, rows from ``table.data``."""
    from .validate import column_names
    x = examples.select(
        "id", "text", "split", F.col("schema.table_id").alias("table_id"),
        column_names("schema.columns").alias("schema_names"), column_names("table.columns").alias("table_names"),
        F.coalesce(F.col("table.data"), F.array().cast("array<array<string>>")).alias("rows"))
    return table_stage_rows(x, **kwargs)
