"""Queries for chat rows, buckets and step plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import char_len, json_object
from ..operators import chat
from . import sqltext as S
from .registry import query, table

VALID_TURN = "trim(coalesce(role, '')) <> ''"
DEVICES = 2


@query("conversation_messages", sql=f"""
SELECT conv_id,
       count(*)::BIGINT AS n_messages,
       sum(length(coalesce(text, 'None')))::BIGINT AS char_len,
       arg_min(trim(role), turn) AS first_role,
       arg_max(trim(role), turn) AS last_role,
       string_agg(trim(role), ',' ORDER BY turn) AS roles
FROM conversations WHERE {VALID_TURN}
GROUP BY conv_id
""")
def conversation_messages(spark, sf_dir):
    m = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    return m.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        "char_len",
        F.col("messages")[0]["role"].alias("first_role"),
        F.element_at("messages", -1)["role"].alias("last_role"),
        F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
    )


def _conv_metadata(conv):
    """Per-conversation metadata object ``{"conv_id": n, "n_turns": k}`` (F14 form)."""
    return conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id",
        json_object([("conv_id", F.col("conv_id").cast("string")),
                     ("n_turns", F.col("n").cast("string"))]).alias("metadata"))


@query("conversation_metadata_injection", sql=f"""
WITH c AS (
  SELECT conv_id,
         count(*) AS n_all,
         count(*) FILTER (WHERE {VALID_TURN}) AS n_turns,
         sum(length(coalesce(text, 'None'))) FILTER (WHERE {VALID_TURN}) AS turn_chars,
         arg_min(role, turn) AS first_raw_role,
         arg_min(trim(role), turn) FILTER (WHERE {VALID_TURN}) AS first_role_clean,
         arg_min(coalesce(text, 'None'), turn) FILTER (WHERE {VALID_TURN}) AS first_text
  FROM conversations GROUP BY conv_id),
m AS (
  SELECT *, '[METADATA]' || chr(10) || '{{"conv_id": ' || conv_id || ', "n_turns": ' || n_all || '}}' AS md,
         coalesce(first_raw_role, '') <> 'system' AS inject
  FROM c)
SELECT conv_id,
       (n_turns + CASE WHEN inject THEN 1 ELSE 0 END)::BIGINT AS n_messages,
       (coalesce(turn_chars, 0) + CASE WHEN inject THEN length(md) ELSE 0 END)::BIGINT AS char_len,
       CASE WHEN inject THEN 'system' ELSE first_role_clean END AS first_role,
       md5(CASE WHEN inject THEN md ELSE first_text END) AS first_content_md5
FROM m
""")
def conversation_metadata_injection(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    m = chat.messages_from_turns(conv, metadata=_conv_metadata(conv))
    return m.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        "char_len",
        F.col("messages")[0]["role"].alias("first_role"),
        F.md5(F.col("messages")[0]["content"]).alias("first_content_md5"),
    )


def _staged_sources(spark, sf_dir):
    conv = chat.conversation_lengths(table(spark, sf_dir, "conversations"))
    docs = table(spark, sf_dir, "documents").select(
        char_len(F.coalesce("text", F.lit("None"))).alias("char_len"))
    both = (conv.select(F.lit("conversations").alias("source"), "char_len")
            .unionByName(docs.select(F.lit("documents").alias("source"), "char_len")))
    return chat.with_length_stage(both)


_STAGED_SQL = f"""
WITH l AS (
  SELECT 'conversations' AS source, sum(length(coalesce(text, 'None')))::BIGINT AS char_len
  FROM conversations WHERE {VALID_TURN} GROUP BY conv_id
  UNION ALL
  SELECT 'documents' AS source, length(coalesce(text, 'None'))::BIGINT AS char_len FROM documents),
s AS (SELECT source, CASE WHEN char_len < 4096 THEN 1 WHEN char_len < 8192 THEN 2 ELSE 3 END AS stage FROM l),
cnt AS (SELECT source, stage, count(*) AS n FROM s GROUP BY source, stage),
tot AS (SELECT source, count(*)::BIGINT AS total_rows FROM s GROUP BY source),
grid AS (SELECT source, total_rows, unnest([1, 2, 3]) AS stage FROM tot),
counts AS (
  SELECT grid.source, grid.stage, coalesce(cnt.n, 0)::BIGINT AS n_rows, grid.total_rows,
         (CASE WHEN coalesce(cnt.n, 0) = 0 THEN grid.total_rows ELSE cnt.n END)::BIGINT AS effective_rows
  FROM grid LEFT JOIN cnt ON grid.source = cnt.source AND grid.stage = cnt.stage)
"""


@query("stage_bucket_counts", sql=_STAGED_SQL + "SELECT * FROM counts")
def stage_bucket_counts(spark, sf_dir):
    c = chat.stage_counts(_staged_sources(spark, sf_dir), ["source"])
    return c.select("source", "stage", "n_rows", "total_rows", "effective_rows")


@query("stage_step_plan", sql=_STAGED_SQL + f"""
, plan AS (SELECT * FROM (VALUES (1, {8 * 4 * DEVICES}, 640), (2, {4 * 8 * DEVICES}, 804),
                                 (3, {2 * 16 * DEVICES}, 804)) t(stage, global_batch, target_steps)),
p AS (
  SELECT counts.source, counts.stage, counts.effective_rows, plan.global_batch, plan.target_steps,
         greatest(1, ceil(counts.effective_rows / plan.global_batch))::BIGINT AS steps_per_epoch
  FROM counts JOIN plan ON counts.stage = plan.stage)
SELECT source, stage, effective_rows, global_batch, target_steps, steps_per_epoch,
       greatest(1, ceil(target_steps / steps_per_epoch))::BIGINT AS epochs,
       (steps_per_epoch * greatest(1, ceil(target_steps / steps_per_epoch)))::BIGINT AS total_steps
FROM p
""")
def stage_step_plan(spark, sf_dir):
    counts = chat.stage_counts(_staged_sources(spark, sf_dir), ["source"])
    plan = chat.step_plan(counts, chat.StagePlanConfig(devices=DEVICES))
    return plan.select("source", "stage", "effective_rows", "global_batch", "target_steps",
                       "steps_per_epoch", "epochs", "total_steps")


@query("stage_step_plan_capped", sql=_STAGED_SQL + f"""
SELECT source, stage, effective_rows, 200::BIGINT AS steps_per_epoch, 1::BIGINT AS epochs,
       200::BIGINT AS total_steps, (200 * {8 * 4 * DEVICES})::BIGINT AS max_samples
FROM counts
""")
def stage_step_plan_capped(spark, sf_dir):
    counts = chat.stage_counts(_staged_sources(spark, sf_dir), ["source"])
    plan = chat.step_plan(counts, chat.StagePlanConfig(devices=DEVICES, max_steps=200))
    return plan.select("source", "stage", "effective_rows", "steps_per_epoch", "epochs",
                       "total_steps", "max_samples")


@query("chat_text_flatten", sql=f"""
WITH f AS (
  SELECT conv_id,
         string_agg(trim(role) || ': ' || coalesce(text, 'None'), chr(10) ORDER BY turn) AS t
  FROM conversations WHERE {VALID_TURN} GROUP BY conv_id)
SELECT conv_id, length(t)::BIGINT AS text_chars, md5(t) AS text_md5,
       md5(t || chr(10) || 'assistant: ') AS prompt_md5
FROM f WHERE length(t) > 0
""")
def chat_text_flatten(spark, sf_dir):
    m = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    out = m.select("conv_id", chat.flatten_chat("messages").alias("t"),
                   chat.flatten_chat("messages", prompt=True).alias("p"))
    out = out.filter(F.length("t") > 0)
    return out.select("conv_id", char_len("t").alias("text_chars"), F.md5("t").alias("text_md5"),
                      F.md5("p").alias("prompt_md5"))


@query("eval_head_sample", sql="""
SELECT doc_id, lang, length(coalesce(text, 'None'))::BIGINT AS char_len
FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 100
""")
def eval_head_sample(spark, sf_dir):
    """P9 + P10: the first N evaluation rows by an explicit key (limit is the feature)."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return (d.orderBy("doc_id").limit(100)
            .select("doc_id", "lang", char_len(F.coalesce("text", F.lit("None"))).alias("char_len")))


# F1 F2 ----------------------------------------------------------------------------------------
@query("missing_cells", sql=f"""
WITH l AS (SELECT doc_id, unnest({S.lines('text')}) AS line FROM documents)
SELECT documents.doc_id,
       count(l.line)::BIGINT AS n_lines,
       count(l.line) FILTER (WHERE {S.missing('l.line')})::BIGINT AS n_missing,
       coalesce(sum(length({S.strip('l.line')})), 0)::BIGINT AS normalized_chars
FROM documents LEFT JOIN l ON documents.doc_id = l.doc_id
GROUP BY documents.doc_id
""")
def missing_cells(spark, sf_dir):
    """Each document line as a cell: missing tokens (F1) and normalised length (F2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.py_lines("text").alias("ls"))
    return d.select(
        "doc_id", F.size("ls").cast("bigint").alias("n_lines"),
        F.size(F.filter("ls", lambda x: T.is_missing(x))).cast("bigint").alias("n_missing"),
        F.aggregate("ls", F.lit(0).cast("bigint"),
                    lambda acc, x: acc + F.length(T.normalize_cell(x))).alias("normalized_chars"))
