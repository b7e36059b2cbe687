"""Chat-row normalisation, length buckets and the step plan.

Input is long form, one row per turn ``(key, order, role, content)``; that is
what a columnar store holds and what Spark partitions well.  Lengths and
stages come from a plain hash aggregation (map-side partial sums), so they
never gather a conversation in one place; only :func:`messages_from_turns`
builds the per-conversation array, because that array *is* its output row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import py_strip

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _clean_turns(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """Turn-level part of M14: trimmed role, role-less turns flagged, null -> ``None``."""
    return turns.select(
        F.col(key).alias("_key"),
        F.col(order).alias("_ord"),
        F.col(role).alias("_raw_role"),
        py_strip(F.coalesce(F.col(role), F.lit(""))).alias("_role"),
        F.coalesce(F.col(content).cast("string"), F.lit("None")).alias("_content"),
    ).withColumn("_ok", F.col("_role") != "")


def _metadata_turn(md: Column) -> Column:
    return F.concat(F.lit(K.METADATA_TURN_PREFIX), md)


def conversation_lengths(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                         role: str = "role", content: str = "text",
                         metadata: DataFrame | None = None, metadata_col: str = "metadata") -> DataFrame:
    """M14 + F13 without building arrays: ``(key, n_messages, char_len, first_role)``.

    ``metadata`` is an optional ``(key, metadata)`` relation (JSON text); its
    injected system turn counts toward ``char_len`` exactly as in M14.
    """
    t = _clean_turns(turns, key, order, role, content)
    agg = t.groupBy("_key").agg(
        F.min_by("_raw_role", "_ord").alias("first_role"),
        F.count(F.when(F.col("_ok"), 1)).alias("n_turns"),
        F.sum(F.when(F.col("_ok"), F.length("_content"))).cast("bigint").alias("turn_chars"),
    )
    if metadata is not None:
        md = metadata.select(F.col(key).alias("_key"), F.col(metadata_col).alias("_md"))
        agg = agg.join(md, "_key", "left")
        inject = F.col("_md").isNotNull() & ~F.coalesce(F.col("first_role") == "system", F.lit(False))
        agg = agg.select(
            "_key", "first_role",
            (F.col("n_turns") + F.when(inject, 1).otherwise(0)).cast("bigint").alias("n_messages"),
            (F.coalesce(F.col("turn_chars"), F.lit(0))
             + F.when(inject, F.length(_metadata_turn(F.col("_md")))).otherwise(0)).cast("bigint").alias("char_len"),
        )
    else:
        agg = agg.select("_key", "first_role", F.col("n_turns").cast("bigint").alias("n_messages"),
                         F.coalesce(F.col("turn_chars"), F.lit(0)).cast("bigint").alias("char_len"))
    return agg.filter(F.col("n_messages") > 0).withColumnRenamed("_key", key)


def messages_from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                        role: str = "role", content: str = "text",
                        metadata: DataFrame | None = None, metadata_col: str = "metadata") -> DataFrame:
    """One chat row per key, ``messages`` ordered by ``order``, plus ``char_len``.

    A metadata system turn is put first when the first raw turn is not a
    system turn; role-less turns are dropped; rows left empty are dropped.
    The only shuffle is the hash partitioning on ``key``.
    """
    t = _clean_turns(turns, key, order, role, content)
    agg = t.groupBy("_key").agg(
        F.min_by("_raw_role", "_ord").alias("first_role"),
        F.sort_array(F.collect_list(F.when(F.col("_ok"), F.struct("_ord", "_role", "_content")))).alias("_turns"),
    )
    msgs = F.transform("_turns", lambda x: F.struct(x["_role"].alias("role"), x["_content"].alias("content")))
    if metadata is not None:
        md = metadata.select(F.col(key).alias("_key"), F.col(metadata_col).alias("_md"))
        agg = agg.join(md, "_key", "left")
        inject = F.col("_md").isNotNull() & ~F.coalesce(F.col("first_role") == "system", F.lit(False))
        sys_turn = F.array(F.struct(F.lit("system").alias("role"), _metadata_turn(F.col("_md")).alias("content")))
        msgs = F.when(inject, F.concat(sys_turn, msgs)).otherwise(msgs)
    out = agg.select(F.col("_key").alias(key), msgs.alias("messages"), "first_role")
    out = out.withColumn(
        "char_len",
        F.aggregate("messages", F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(m["content"])))
    return out.filter(F.size("messages") > 0)


def chat_rows_from_lines(lines: DataFrame, line_col: str = "line", keep: list[str] | None = None) -> DataFrame:
    """M14 + F12 + F13 over JSONL message rows: ``(keep..., messages, char_len)``.

    A small Arrow-batched helper decodes a line into its turns and metadata,
    with Python's JSON text of list/dict contents and metadata (it is part of
    the result and of ``char_len``).  Column functions choose the turn list,
    put the metadata turn first, and drop turns that are no objects or have no
    role; lines without turns left (blank, invalid, no list) are dropped.
    """
    from ..functions.strict_json import chat_parts
    keep = keep or []
    x = lines.select(*keep, chat_parts(py_strip(line_col)).alias("_p"))
    turns = F.when(F.col("_p.has_messages"), F.col("_p.messages")).otherwise(F.col("_p.conversations"))
    x = x.withColumn("_turns", turns).filter(F.size("_turns") > 0)
    first = F.element_at("_turns", 1)["role"]
    inject = F.col("_p.metadata").isNotNull() & ~F.coalesce(first == "system", F.lit(False))
    shown = F.struct(F.lit(True).alias("is_object"), F.lit("system").alias("role"),
                     _metadata_turn(F.col("_p.metadata")).alias("content"))
    turns = F.when(inject, F.concat(F.array(shown), F.col("_turns"))).otherwise(F.col("_turns"))
    named = F.filter(turns, lambda t: t["is_object"] & (F.coalesce(py_strip(t["role"]), F.lit("")) != ""))
    messages = F.transform(named, lambda t: F.struct(py_strip(t["role"]).alias("role"), t["content"].alias("content")))
    x = x.select(*keep, messages.alias("messages")).filter(F.size("messages") > 0)
    clen = F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.length(m["content"]))
    return x.withColumn("char_len", clen.cast("int"))


# M15 ------------------------------------------------------------------------
def bucket_thresholds(context_lengths=None, chars_per_token: float = K.CHARS_PER_TOKEN,
                      margin: float = K.BUCKET_MARGIN) -> tuple[int, int]:
    lens = context_lengths or K.CONTEXT_LENGTHS
    return int(margin * chars_per_token * lens[1]), int(margin * chars_per_token * lens[2])


def length_stage(char_len, thresholds: tuple[int, int] | None = None) -> Column:
    t2, t3 = thresholds or bucket_thresholds()
    c = F.col(char_len) if isinstance(char_len, str) else char_len
    return F.when(c < t2, F.lit(1)).when(c < t3, F.lit(2)).otherwise(F.lit(3))


def with_length_stage(df: DataFrame, char_len: str = "char_len",
                      thresholds: tuple[int, int] | None = None) -> DataFrame:
    return df.withColumn("stage", length_stage(char_len, thresholds))


def write_length_buckets(df: DataFrame, path: str, char_len: str = "char_len",
                         thresholds: tuple[int, int] | None = None) -> None:
    """Scan once, write all three buckets: one ``partitionBy("stage")`` write, no shuffle."""
    (with_length_stage(df, char_len, thresholds).write.mode("overwrite")
     .option("compression", "zstd").partitionBy("stage").parquet(path))


# A11 / M16 -------------------------------------------------------------------
@dataclass
class StagePlanConfig:
    hours: list = field(default_factory=lambda: list(K.STAGE_HOURS))
    micro_batch: list = field(default_factory=lambda: list(K.STAGE_MICRO_BATCH))
    grad_accum: list = field(default_factory=lambda: list(K.STAGE_GRAD_ACCUM))
    devices: int = 1
    est_step_seconds: float = K.EST_STEP_SECONDS
    max_steps: int | None = None

    def target_steps(self, stage: int) -> int:
        safe = max(0, int(self.hours[stage - 1] * 3600) - K.TIME_SAFETY_SECONDS)
        return max(K.MIN_TARGET_STEPS, safe // max(1, int(self.est_step_seconds)))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for s in (1, 2, 3):
            rows.append((s, self.micro_batch[s - 1] * self.grad_accum[s - 1] * max(1, self.devices),
                         self.target_steps(s)))
        return spark.createDataFrame(rows, "stage int, global_batch int, target_steps int")


def stage_counts(staged: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A11 + M16: rows per stage (all three stages present) and the fallback count.

    The per-stage count is a partial aggregation (3 groups per map task), so
    the shuffle is a handful of rows whatever the input size.
    """
    group_cols = group_cols or []
    counts = staged.groupBy(*group_cols, "stage").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy(*group_cols).agg(F.sum("n_rows").cast("bigint").alias("total_rows"))
    grid = totals.select(*group_cols, "total_rows",
                         F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("stage"))
    out = grid.join(counts, group_cols + ["stage"], "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0)).cast("bigint"))
    return out.withColumn("effective_rows",
                          F.when(F.col("n_rows") == 0, F.col("total_rows")).otherwise(F.col("n_rows")))


def step_plan(counts: DataFrame, cfg: StagePlanConfig | None = None, rows_col: str = "effective_rows") -> DataFrame:
    """Steps per epoch, epochs and total steps per stage (optionally hard-capped)."""
    cfg = cfg or StagePlanConfig()
    plan = F.broadcast(cfg.frame(counts.sparkSession))  # 3 rows, size fixed
    df = counts.join(plan, "stage")
    spe = F.greatest(F.lit(1), F.ceil(F.col(rows_col) / F.col("global_batch"))).cast("bigint")
    df = df.withColumn("steps_per_epoch", spe)
    df = df.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("target_steps") / F.col("steps_per_epoch"))).cast("bigint"))
    df = df.withColumn("total_steps", (F.col("steps_per_epoch") * F.col("epochs")).cast("bigint"))
    df = df.withColumn("max_samples", F.lit(None).cast("bigint"))
    if cfg.max_steps is not None and cfg.max_steps > 0:
        df = (df.withColumn("total_steps", F.lit(cfg.max_steps).cast("bigint"))
              .withColumn("epochs", F.lit(1).cast("bigint"))
              .withColumn("steps_per_epoch", F.lit(cfg.max_steps).cast("bigint"))
              .withColumn("max_samples", (F.lit(cfg.max_steps) * F.col("global_batch")).cast("bigint")))
    return df


# M17 ------------------------------------------------------------------------
def flatten_chat(messages, prompt: bool = False) -> Column:
    """``role: content`` lines; the prompt form ends with ``assistant: ``."""
    m = F.col(messages) if isinstance(messages, str) else messages
    body = F.array_join(F.transform(m, lambda x: F.concat(F.coalesce(x["role"], F.lit("user")), F.lit(": "),
                                                          F.coalesce(x["content"], F.lit("")))), "\n")
    return F.concat(body, F.lit("\nassistant: ")) if prompt else body


def flatten_chat_from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                            role: str = "role", content: str = "text", prompt: bool = False) -> DataFrame:
    """M17 over long-form turns, with P10 (drop empty texts)."""
    m = messages_from_turns(turns, key, order, role, content)
    out = m.select(key, flatten_chat("messages", prompt).alias("text"))
    return out.filter(F.length("text") > 0)
