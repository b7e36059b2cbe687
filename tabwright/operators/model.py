"""Model-call jobs (G1-G3): the model is a caller-supplied callable.

``call_model`` runs the callable inside ``mapInPandas`` on Arrow batches, so
Spark partitions the prompts across executors and each task calls the
model on small batches.  Stages of a chain are written to the shared
folder between calls (S10), so a lost executor never re-runs a finished
model stage through lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import prompts as PR
from ..sources.files import materialize, scratch_path
from . import extract, messages


class ModelOutputError(RuntimeError):
    pass


def _as_prompt(v):
    """Arrow hands arrays of structs to pandas as arrays of dicts; pass plain lists."""
    if v is None or isinstance(v, str):
        return v
    return [dict(m) for m in v]


#: Models of this Python worker by factory: a worker serves many tasks and sets a model up once.
_MODELS: dict[tuple, Callable] = {}


@dataclass(frozen=True)
class ModelFactory:
    """How a worker gets its model: ``build(*args)`` returns the callable.

    Factories with equal ``key`` (default: the builder's name and arguments) share a worker's model.
    """
    build: Callable
    args: tuple = ()
    key: str | None = None

    def model(self) -> Callable:
        key = (self.key or f"{self.build.__module__}.{self.build.__qualname__}", self.args)
        if key not in _MODELS:
            _MODELS[key] = self.build(*self.args)
        return _MODELS[key]


def _completions(fn: Callable, prompts: list) -> list[str]:
    res = fn(prompts)
    if res is None or len(res) != len(prompts):
        raise ModelOutputError(f"model returned {0 if res is None else len(res)} outputs for {len(prompts)} prompts")
    if any(r is None for r in res):
        raise ModelOutputError("no output returned for a prompt")
    return [str(r).strip() for r in res]


def _tried(fn: Callable, prompts: list, retries: int) -> list[str]:
    for left in range(retries, -1, -1):
        try:
            return _completions(fn, prompts)
        except Exception:
            if not left:
                raise
    raise AssertionError("unreachable")


def call_model(df: DataFrame, prompt_col: str, fn: Callable[[list], list[str]] | ModelFactory, out_col: str = "completion",
               batch_size: int = 8, retries: int = 0, error_col: str | None = None) -> DataFrame:
    """G1 + G2: completions for every non-null prompt, trimmed, order kept.

    ``fn`` takes a list of prompts (strings, or chat turns as lists of
    ``{"role", "content"}`` dicts) and returns one string per prompt; a
    missing completion is an error.  Null prompts bypass the model.  A
    :class:`ModelFactory` is asked once in each Python worker.

    A failing batch is tried ``retries`` times more.  Without ``error_col`` the
    job then fails.  With it the batch's prompts are called one by one, and a prompt
    that still fails has a null completion and its error as text (E9).
    """
    fields = [*df.schema.fields, TY.StructField(out_col, TY.StringType())]
    if error_col:
        fields.append(TY.StructField(error_col, TY.StringType()))

    def run(batches):
        call = fn.model() if isinstance(fn, ModelFactory) else fn
        for pdf in batches:
            prompts = pdf[prompt_col].map(_as_prompt).tolist()
            idx = [i for i, p in enumerate(prompts) if p is not None and (not isinstance(p, list) or p)]
            out, errors = [None] * len(prompts), [None] * len(prompts)
            for s in range(0, len(idx), batch_size):
                chunk = idx[s:s + batch_size]
                try:
                    for i, r in zip(chunk, _tried(call, [prompts[i] for i in chunk], retries)):
                        out[i] = r
                except Exception:
                    if not error_col:
                        raise
                    for i in chunk:
                        try:
                            out[i] = _tried(call, [prompts[i]], retries)[0]
                        except Exception as e:  # noqa: BLE001  (a record's error is its result)
                            errors[i] = f"{type(e).__name__}: {e}"
            cols = {out_col: out} | ({error_col: errors} if error_col else {})
            yield pdf.assign(**{c: pd.Series(v, index=pdf.index, dtype=object) for c, v in cols.items()})

    return df.mapInPandas(run, TY.StructType(fields))


def run_chain(records: DataFrame, key: str, text_col: str, statement_fn, schema_fn, table_fn,
              workdir: str | None = None, batch_size: int = 8) -> dict[str, DataFrame]:
    """Text -> statements -> schema -> tables, each stage persisted.

    Returns the three stage tables plus the parsed relations:
    ``statements(key, pos, statement)``, ``fields`` (A5 of the schema
    block) and ``tables`` / ``rows`` (X4).  Unknown input columns are
    carried through the stage tables (P6).
    """
    spark = records.sparkSession
    workdir = workdir or scratch_path(spark, "chain")
    # stage 1: statements
    s1 = records.withColumn("_prompt", messages.statement_prompt(F.col(text_col)))
    s1 = call_model(s1, "_prompt", statement_fn, "raw_output", batch_size).drop("_prompt")
    s1 = extract.with_atomic_statements(s1, "raw_output", "atomic_statements")
    st1 = materialize(lambda: s1, spark, f"{workdir}/statements")
    # stage 2: schema
    s2 = st1.withColumn("_prompt", messages.schema_prompt(F.col("atomic_statements")))
    s2 = call_model(s2, "_prompt", schema_fn, "schema_raw_output", batch_size).drop("_prompt")
    st2 = materialize(lambda: s2, spark, f"{workdir}/schema")
    # stage 3: tables (schema text is the raw schema output)
    s3 = st2.withColumn("_prompt", messages.table_prompt(F.col("atomic_statements"), F.col("schema_raw_output")))
    s3 = call_model(s3, "_prompt", table_fn, "tables_raw_output", batch_size).drop("_prompt")
    st3 = materialize(lambda: s3, spark, f"{workdir}/tables")
    explicit, fields = extract.parse_schema_outputs(st2, key, "schema_raw_output")
    tables, rows = extract.parse_markdown_tables(st3, key, "tables_raw_output")
    statements = st3.select(key, F.posexplode("atomic_statements").alias("pos", "statement"))
    return {"stage1": st1, "stage2": st2, "stage3": st3, "statements": statements,
            "fields": fields, "schema": extract.schema_objects(explicit, fields, key),
            "tables": tables, "rows": rows}


def unroll_prompts(markdown_df: DataFrame, markdown_col: str = "markdown") -> DataFrame:
    """M12 prompts for G4/G5 when a model, not the deterministic unroll, is wanted."""
    return markdown_df.withColumn("prompt", messages.unroll_prompt(F.col(markdown_col)))


# Deterministic stand-ins used by the registered queries and tests -------------------------
def _user_text(prompt) -> str:
    if isinstance(prompt, str):
        return prompt
    users = [m.get("content") or "" for m in prompt if m.get("role") == "user"]
    return users[-1] if users else ""


def echo_statements(prompts: list) -> list[str]:
    """Statement stand-in: the non-blank lines of the input text as statements."""
    out = []
    for p in prompts:
        text = _user_text(p)
        if text.startswith(PR.STATEMENT_USER_PREFIX):
            text = text[len(PR.STATEMENT_USER_PREFIX):]
        lines = [ln.strip() for ln in text.splitlines() if ln.strip()]
        out.append("Reasoning.\n\n### Atomic Statements:\n" + "\n".join(lines))
    return out


def _numbered(text: str, head: str) -> list[str]:
    body = text.split(head, 1)[1] if head in text else text
    body = body.split("\n\n", 1)[0]
    out = []
    for ln in body.splitlines():
        dot = ln.find(". ")
        if dot > 0 and ln[:dot].isdigit():
            out.append(ln[dot + 2:])
    return out


class LineReader:
    """Statement stand-in with a limit: it refuses texts with a line beyond ``longest`` characters."""

    def __init__(self, longest: int):
        self.longest = longest

    def __call__(self, prompts: list) -> list[str]:
        if any(len(ln) > self.longest for p in prompts for ln in _user_text(p).splitlines()):
            raise ValueError(f"a line beyond {self.longest} characters")
        return echo_statements(prompts)


def first_word_schema(prompts: list) -> list[str]:
    """Schema stand-in: one table ``Doc`` whose headers are the first word of each statement."""
    import json
    out = []
    for p in prompts:
        st = _numbered(_user_text(p), "### Atomic Statements:\n")
        heads = [s.split()[0] for s in st if s.split()]
        out.append("### Final Schema:\n" + json.dumps({"Doc": {"row_headers": [], "column_headers": heads}},
                                                      ensure_ascii=False))
    return out


def statement_table(prompts: list) -> list[str]:
    """Table stand-in: table ``Doc`` with one row (n, statement) per statement."""
    out = []
    for p in prompts:
        st = _numbered(_user_text(p), "### Statements:\n")
        rows = "\n".join(f"| {i + 1} | {s} |" for i, s in enumerate(st))
        out.append("### Final Output Tables:\n\n### Doc\n| n | statement |\n" + rows)
    return out
