"""Record validation (P1-P8): violations as data, one narrow stage.

Instead of stopping at the first bad record, every record gets a
``violations`` array; callers split accepted / rejected rows, or raise in
strict mode with the first rejected record's id and reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T


class ValidationError(ValueError):
    pass


def column_names(columns) -> Column:
    """``[c.name or '']`` of a columns array."""
    c = F.col(columns) if isinstance(columns, str) else columns
    return F.transform(F.coalesce(c, F.array()), lambda x: F.coalesce(x["name"], F.lit("")))


def usable_for_schema_stage(df: DataFrame, text_col: str = "text", columns_col: str = "schema.columns") -> DataFrame:
    """Non-blank text, a schema with at least one column."""
    text = T.py_strip(F.coalesce(F.col(text_col), F.lit("")))
    return df.filter((text != "") & (F.coalesce(F.size(columns_col), F.lit(0)) > 0))


def example_violations(id_col: Column, text_col: Column, schema_table_id: Column, table_table_id: Column,
                       schema_cols: Column, table_cols: Column) -> Column:
    """Reasons a merged example is invalid (empty array when valid)."""
    missing = F.array_except(schema_cols, table_cols)
    checks = [
        F.when(id_col.isNull() | (id_col == ""), F.lit("missing non-empty 'id'")),
        F.when(text_col.isNull() | (T.py_strip(text_col) == ""), F.lit("missing/empty 'text'")),
        F.when(~schema_table_id.eqNullSafe(table_table_id), F.lit("schema.table_id != table.table_id")),
        F.when(F.size(missing) > 0, F.concat(F.lit("table missing schema columns: "),
                                             F.array_join(missing, ", "))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def with_violations(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """P2 over the merged-example schema (``schema`` and ``table`` structs)."""
    v = example_violations(F.col(id_col).cast("string"), F.col(text_col), F.col("schema.table_id"),
                           F.col("table.table_id"), column_names("schema.columns"), column_names("table.columns"))
    return df.withColumn("violations", v)


def raise_on_violations(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Strict mode: fail with the first rejected record (smallest id); else pass through."""
    bad = df.filter(F.size("violations") > 0).select(id_col, "violations").orderBy(id_col).limit(1).collect()
    if bad:
        raise ValidationError(f"id={bad[0][0]}: {'; '.join(bad[0][1])}")
    return df


def text_with_fallback(summary: str = "summary", text: str = "text") -> Column:
    """``summary or text`` (an empty summary falls through)."""
    return F.when(F.col(summary).isNotNull() & (F.col(summary) != ""), F.col(summary)).otherwise(F.col(text))


NO_TEXT = "no 'summary' or 'text'"


def with_input_text(df: DataFrame, summary: str = "summary", text: str = "text", out_col: str = "input_text") -> DataFrame:
    """P3 on every record: the text, or ``reason`` where it has neither."""
    out = df.withColumn(out_col, text_with_fallback(summary, text))
    return out.withColumn("reason", F.when(F.col(out_col).isNull(), F.lit(NO_TEXT)))


def split_on_reason(df: DataFrame, reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: a row is in exactly one, by its ``reason``; the accepted ones lose that column.

    Both are filters over one projection; persist ``df`` (S10) where its source is dear.
    """
    return df.filter(F.col(reason_col).isNull()).drop(reason_col), df.filter(F.col(reason_col).isNotNull())


def observe_reasons(df: DataFrame, observation: Observation, reasons: list[str], reason_col: str = "reason") -> DataFrame:
    """``df`` with failure counts: ``n_rows``, ``n_rejected`` and one count per known reason, ready when it was computed."""
    counts = [F.count_if(F.col(reason_col) == r).alias(r) for r in reasons]
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows"), F.count(reason_col).alias("n_rejected"), *counts)


def nonempty_table(columns: str = "table.columns", data: str = "table.data") -> Column:
    """A table with columns and rows (else no prompt and no output)."""
    return (F.coalesce(F.size(columns), F.lit(0)) > 0) & (F.coalesce(F.size(data), F.lit(0)) > 0)


def json_field_types(raw_json: str, expected: dict[str, str]) -> Column:
    """P5: reasons a raw JSON record's fields have the wrong type.

    ``expected`` maps a field to ``array`` / ``string`` / ``object``; the
    record is parsed once as a variant.
    """
    v = F.try_parse_json(F.col(raw_json))
    checks = []
    for name, kind in expected.items():
        f = F.try_variant_get(v, f"$.{name}", "variant")
        typ = F.schema_of_variant(f)
        ok = F.upper(typ).startswith({"array": "ARRAY", "string": "STRING", "object": "OBJECT"}[kind])
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"'{name}' is not a {kind}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
