"""Queries for sources/sinks, model-call jobs and incremental runs
(S1-S4, S8-S14, S17, P4, P6, G1-G3, G7).

Input files are written by Spark from the driver tables into a fresh
folder under the shared checkpoint directory, then read back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, extract, messages
from ..operators import model as MD
from ..sources import files as SF
from ..sources import jsonl as SJ
from ..streaming import run_incremental
from . import sqltext as S
from .registry import query, table

DOC_SCHEMA = "doc_id bigint, lang string, source string, n_chars bigint, text string"


UNKNOWN_SQL = "CASE WHEN lang = 'fr' THEN 1 ELSE 0 END"
BAD_SQL = "(lang IN ('de', 'es') OR (lang = 'en' AND source = 'src1'))"


def _doc_lines(spark, sf_dir):
    """One JSON line per document, with faults that follow the data.

    German lines are cut short, Spanish ones have single quotes, English ones of
    ``src1`` text behind the object: no JSON.  French ones hold ``n_chars`` as text and
    an undeclared ``note``, English ones of ``src2`` a fraction there: JSON all the same.
    A blank line follows documents of ``src0``.
    """
    d = table(spark, sf_dir, "documents")
    cols = ["doc_id", "lang", "source", "n_chars", "text"]
    js = F.to_json(F.struct(*cols))
    noted = F.to_json(F.struct("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("n_chars"), "text",
                               F.struct(F.col("lang").alias("of"), F.array(F.col("source")).alias("in")).alias("note")))
    part = F.to_json(F.struct("doc_id", "lang", "source", (F.col("n_chars") + F.lit(0.5)).alias("n_chars"), "text"))
    line = (F.when(F.col("lang") == "de", F.regexp_replace(js, r"\}$", ""))
            .when(F.col("lang") == "es", F.replace(js, F.lit('"'), F.lit("'")))
            .when(F.col("lang") == "fr", noted)
            .when(F.col("source") == "src1", F.concat(js, F.lit(" trailing")))
            .when(F.col("source") == "src2", part).otherwise(js))
    line = F.when(F.col("source") == "src0", F.concat(line, F.lit("\n"))).otherwise(line)
    return d.select("doc_id", line.alias("value"))


def _write_doc_jsonl(spark, sf_dir) -> str:
    """Part files whose lines follow ``doc_id`` through the files in name order."""
    path = SF.scratch_path(spark, "jsonl")
    (_doc_lines(spark, sf_dir).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
     .select("value").write.mode("overwrite").text(path))
    return path


def _from_first_file(numbered):
    """Lines numbered through all files in name order: ``line_no`` plus the lines of the files before."""
    files = numbered.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)      # one row a file
    files = files.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(files, "file_path")


_LINES_SQL = """
WITH d AS (SELECT *, CASE WHEN source = 'src0' THEN 2 ELSE 1 END AS n_lines FROM documents),
l AS (SELECT *, CAST(coalesce(sum(n_lines) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS BIGINT) AS before FROM d)
"""


# S1 P6 ---------------------------------------------------------------------------------------
@query("jsonl_lenient", sql=f"""
SELECT doc_id, lang, CASE WHEN lang = 'en' AND source = 'src2' THEN NULL ELSE n_chars END AS n_chars,
       md5(text) AS text_md5, {UNKNOWN_SQL}::BIGINT AS n_unknown, CASE WHEN lang = 'fr' THEN 'fr' END AS note_of
FROM documents WHERE NOT {BAD_SQL}
""")
def jsonl_lenient(spark, sf_dir):
    df = SJ.read_jsonl_lenient(spark, _write_doc_jsonl(spark, sf_dir), DOC_SCHEMA)
    return df.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"),
                     F.size("extra").cast("bigint").alias("n_unknown"),
                     F.try_variant_get(F.element_at("extra", "note"), "$.of", "string").alias("note_of"))


# P6 S11 S12 ----------------------------------------------------------------------------------
@query("jsonl_carry_unknown", sql=f"""
SELECT doc_id, length(text)::BIGINT AS stage_chars, md5(text) AS text_md5, true AS ascii_line,
       CASE WHEN lang = 'fr' THEN source END AS note_in
FROM documents WHERE NOT {BAD_SQL}
""")
def jsonl_carry_unknown(spark, sf_dir):
    """Records pass a stage that adds a field, are written as ASCII JSON lines and read back."""
    df = SJ.read_jsonl_lenient(spark, _write_doc_jsonl(spark, sf_dir), DOC_SCHEMA).drop("file_path", "file_name")
    path = SF.scratch_path(spark, "jsonl-stage")
    SJ.write_jsonl(df.withColumn("stage_chars", T.char_len("text")), path, ascii_only=True)
    lines = SJ.with_records(SJ.read_lines(spark, path)).withColumn("ascii_line", ~F.col("line").rlike(r"[^\x00-\x7F]"))
    back = SJ.with_fields(lines, "doc_id bigint, text string, stage_chars bigint")
    return back.select("doc_id", "stage_chars", F.md5("text").alias("text_md5"), "ascii_line",
                       F.try_variant_get(F.element_at("extra", "note"), "$.in[0]", "string").alias("note_in"))


# S2 P4 ---------------------------------------------------------------------------------------
@query("jsonl_strict_rejects", sql=_LINES_SQL + f"""
SELECT doc_id, before + 1 AS line_no FROM l WHERE {BAD_SQL}
""")
def jsonl_strict_rejects(spark, sf_dir):
    """Malformed lines with their line numbers."""
    lines = _from_first_file(SJ.numbered_lines(spark, _write_doc_jsonl(spark, sf_dir)))
    bad = SJ.with_records(lines).filter("bad")
    return bad.select(F.regexp_extract("line", r"doc_id.:(\d+)", 1).cast("bigint").alias("doc_id"),
                      (F.col("before") + F.col("line_no")).alias("line_no"))


@query("jsonl_default_ids", sql=_LINES_SQL + f"""
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr-' || doc_id ELSE CAST(before AS VARCHAR) END AS id
FROM l WHERE NOT {BAD_SQL}
""")
def jsonl_default_ids(spark, sf_dir):
    """French records have an id of their own, all others get their zero-based line number (through all files)."""
    path = _write_doc_jsonl(spark, sf_dir)
    lines = _from_first_file(SJ.numbered_lines(spark, path))
    own = F.regexp_replace("line", r'^\{"doc_id":(\d+),"lang":"fr"', r'{"id":"fr-$1","doc_id":$1,"lang":"fr"')
    rec = SJ.with_records(lines.withColumn("line", own)).filter(~F.col("bad"))
    rec = SJ.with_default_id(rec.withColumn("line_no", F.col("before") + F.col("line_no")))
    return SJ.with_fields(rec.drop("line"), "doc_id bigint").select("doc_id", "id")


# S3 S4 ---------------------------------------------------------------------------------------
CODECS = {"none": "", "gzip": ".gz", "bzip2": ".bz2", "zstd": ".zst"}
_READ_SQL = "CASE lang WHEN 'en' THEN text || chr(65533) ELSE text END"


@query("compressed_text", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS codec, count(*)::BIGINT AS n_records, sum(n_chars)::BIGINT AS sum_chars, "
    f"sum(CAST('0x' || substr(md5({_READ_SQL}), 1, 7) AS BIGINT))::BIGINT AS sum_md5 FROM documents" for c in CODECS))
def compressed_text(spark, sf_dir):
    """French texts end in bytes that are no UTF-8 and are dropped, English ones in a U+FFFD of their own that stays."""
    d = table(spark, sf_dir, "documents")
    js = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text"))
    tail = (F.when(F.col("lang") == "fr", F.lit(bytearray(b"\xff\xe2\x82")).cast("string"))
            .when(F.col("lang") == "en", F.lit("\ufffd")).otherwise(F.lit("")))
    value = F.concat(F.substring(js, F.lit(1), F.length(js) - 2), tail, F.lit('"}'))
    out = None
    for codec, suffix in CODECS.items():
        path = SF.scratch_path(spark, "jsonl")
        rows = d.select(value.alias("value"))
        if codec == "zstd":
            SJ.write_text_zstd(rows, path)
        else:
            rows.write.option("compression", codec).text(path)
        df = SJ.read_jsonl_lenient(spark, f"{path}/part-*{suffix}", DOC_SCHEMA)
        seven = F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("bigint")
        agg = df.agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).cast("bigint").alias("n_records"),
                     F.sum("n_chars").cast("bigint").alias("sum_chars"), F.sum(seven).alias("sum_md5"))
        out = agg if out is None else out.unionByName(agg)
    return out


# S13 S14 S17 ------------------------------------------------------------------------------------
STEMS = {"en": "news_train", "fr": "news_dev", "de": "constraints", "es": "news_valid"}


@query("split_routing", sql=f"""
WITH d AS (SELECT CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEMS.items())} END AS stem FROM documents)
SELECT CASE WHEN stem LIKE '%train%' THEN 'train' WHEN stem LIKE '%validation%' OR stem LIKE '%dev%' THEN 'validation'
            WHEN stem LIKE '%test%' THEN 'test' ELSE 'data' END AS split,
       stem || '_stage2_messages' AS output, count(*)::BIGINT AS n_records
FROM d GROUP BY ALL
""")
def split_routing(spark, sf_dir):
    """Documents land in one input per language; each input is routed by its name."""
    d = table(spark, sf_dir, "documents")
    stem = F.lit(None).cast("string")
    for k, v in STEMS.items():
        stem = F.when(F.col("lang") == k, F.lit(v)).otherwise(stem)
    root = SF.scratch_path(spark, "routing")
    (d.select(stem.alias("stem"), F.to_json(F.struct("doc_id", "text")).alias("value"))
     .write.mode("overwrite").partitionBy("stem").text(root))
    paths = [f"{root}/stem={v}" for v in STEMS.values()]
    lines = SJ.read_lines(spark, paths)
    name = F.concat(F.regexp_extract("file_path", r"stem=([^/]+)/", 1), F.lit(".jsonl"))
    x = lines.select(name.alias("name"))
    return x.groupBy(SF.split_from_name("name").alias("split"), SF.output_name("name").alias("output")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_records"))


# S8 S9 S10 M15 --------------------------------------------------------------------------------
@query("parquet_cache", sql="""
WITH s AS (SELECT CASE WHEN length(text) < 4096 THEN 1 WHEN length(text) < 8192 THEN 2 ELSE 3 END AS stage FROM documents)
SELECT stage, count(*)::BIGINT AS n_rows, (SELECT count(*) FROM documents)::BIGINT AS cached_rows FROM s GROUP BY stage
""")
def parquet_cache(spark, sf_dir):
    """Chat rows cached as zstd Parquet partitioned by stage, then read back."""
    path = SF.scratch_path(spark, "cache")
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.array(messages.turn("user", F.col("text"))).alias("messages"),
                    T.char_len("text").alias("char_len"))
    cached = SF.materialize(lambda: chat.with_length_stage(rows), spark, path)
    n = SF.parquet_rows(spark, path)
    return cached.groupBy("stage").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "cached_rows", F.lit(n).cast("bigint"))


# G1 G2 -------------------------------------------------------------------------------------------
_STMT_SQL = f"""
WITH d AS (SELECT doc_id, text, list_filter(list_transform({S.lines('text')}, lambda y: {S.strip('y')}), lambda y: y <> '') AS st
           FROM documents),
s AS (SELECT doc_id, st,
             list_position(list_transform(st, lambda y: starts_with(y, '***') OR starts_with(y, '<REASONING STEPS>')), true) AS stop
      FROM d),
k AS (SELECT doc_id, CASE WHEN stop IS NULL OR stop = 0 THEN st ELSE st[1:stop - 1] END AS kept FROM s)
"""


@query("model_call_stub", sql=_STMT_SQL + """
SELECT doc_id, len(kept)::BIGINT AS n_statements, md5(array_to_string(kept, chr(10))) AS statements_md5 FROM k
""")
def model_call_stub(spark, sf_dir):
    """Prompts (M9) through a stand-in model that lists the text's lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", messages.statement_prompt(F.col("text")).alias("prompt"))
    out = MD.call_model(d, "prompt", MD.echo_statements, "raw_output")
    out = extract.with_atomic_statements(out, "raw_output", "st")
    return out.select("doc_id", F.size("st").cast("bigint").alias("n_statements"),
                      F.md5(F.array_join("st", "\n")).alias("statements_md5"))


# G3 ----------------------------------------------------------------------------------------------
@query("chain_stub", sql=_STMT_SQL + f""",
w AS (SELECT doc_id, unnest(kept) AS s FROM k),
f AS (SELECT doc_id, count(DISTINCT {S.snake_plain("regexp_extract(s, '^\\S+')")})
                       FILTER (WHERE {S.snake_plain("regexp_extract(s, '^\\S+')")} NOT IN ('', 'doc_name')) AS nf
      FROM w GROUP BY doc_id)
SELECT k.doc_id, len(kept)::BIGINT AS n_statements, (1 + coalesce(f.nf, 0))::BIGINT AS n_fields,
       len(kept)::BIGINT AS n_rows
FROM k LEFT JOIN f ON k.doc_id = f.doc_id
""")
def chain_stub(spark, sf_dir):
    """Three chained stand-in model stages, each persisted, then parsed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    res = MD.run_chain(d, "doc_id", "text", MD.echo_statements, MD.first_word_schema, MD.statement_table)
    n_st = res["stage3"].select("doc_id", F.size("atomic_statements").cast("bigint").alias("n_statements"))
    n_f = res["fields"].groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_fields"))
    n_r = res["rows"].groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    out = n_st.join(n_f, "doc_id", "left").join(n_r, "doc_id", "left")
    return out.select("doc_id", "n_statements", F.coalesce("n_fields", F.lit(0)).cast("bigint").alias("n_fields"),
                      F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


def records_per_file(n_records: int) -> int:
    """Records of one arriving file: 200, or more where that would make more than 128 files."""
    return max(200, -(-n_records // 128))


# G7 ----------------------------------------------------------------------------------------------
@query("streaming_append", sql=_STMT_SQL + """
SELECT doc_id, len(kept)::BIGINT AS n_statements, md5(array_to_string(kept, chr(10))) AS statements_md5 FROM k
""")
def streaming_append(spark, sf_dir):
    """Documents arrive as files; each micro-batch is prompted, answered and parsed."""
    root = SF.scratch_path(spark, "stream")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # micro-batches hold a fixed number of files: larger tables arrive in larger files (of small row groups, which
    # are read side by side), or the batches, each with its own start and commit, grow with the table
    (d.write.mode("overwrite").option("maxRecordsPerFile", records_per_file(d.count()))
     .option("parquet.block.size", 8 << 20).parquet(f"{root}/in"))

    def transform(src):
        p = src.select("doc_id", messages.statement_prompt(F.col("text")).alias("prompt"))
        out = MD.call_model(p, "prompt", MD.echo_statements, "raw_output")
        return extract.with_atomic_statements(out, "raw_output", "statements").select("doc_id", "statements")

    res = run_incremental(spark, f"{root}/in", d.schema, transform, f"{root}/out", f"{root}/ckpt",
                          max_files_per_trigger=4)
    return res.select("doc_id", F.size("statements").cast("bigint").alias("n_statements"),
                      F.md5(F.array_join("statements", "\n")).alias("statements_md5"))


# S5 S6 S7 S15 S16 X2 -------------------------------------------------------------------------
def _turn_files(spark, sf_dir):
    """One statement file per (role, conversation): the non-blank lines of that
    role's turns, numbered; user turns go to the root folder."""
    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    lines = F.filter(F.transform(F.flatten(F.transform("ts", lambda t: T.py_lines(t["text"]))), T.py_strip),
                     lambda x: x != "")
    per = per.select("conv_id", "role", lines.alias("st"))
    text = F.concat(F.lit("Statements:\n"), T.number_lines("st"), F.lit("\n\nRows:\n"))
    return per.select(F.when(F.col("role") != "user", F.col("role")).alias("category"),
                      F.col("conv_id").alias("id"), text.alias("text"), "conv_id", "role")


_TURN_FILES_SQL = f"""
WITH t AS (SELECT conv_id, role, turn, list_filter(list_transform({S.lines('text')}, lambda y: {S.strip('y')}),
                                                   lambda y: y <> '') AS st FROM conversations),
f AS (SELECT CASE role WHEN 'user' THEN 'Team' ELSE upper(role[1]) || lower(role[2:]) END AS category,
             CAST(conv_id AS VARCHAR) AS id, sum(len(st))::BIGINT AS n_statements FROM t GROUP BY ALL)
"""


@query("statement_dir_categories", sql=_TURN_FILES_SQL + "SELECT category, 'n/é +%' || id AS id, n_statements FROM f")
def statement_dir_categories(spark, sf_dir):
    """One file per (role, conversation) under a root and with ids that file URLs and partitions escape."""
    root = SF.scratch_path(spark, "statements")
    root = f"{root}/a root + 100%"
    files = _turn_files(spark, sf_dir).withColumn("id", F.concat(F.lit("n/é +%"), F.col("id")))
    # turns without a role share the user's file; the first row counts, by the order in which the roles were dealt out
    dealt = F.pmod(F.hash("conv_id", "role"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = files.withColumn("dealt", F.struct(dealt, F.col("role").isNull()))
    SF.write_statement_files(files, root, "category", order_col="dealt")
    d = extract.with_numbered_statements(SF.read_statement_dir(spark, root), "text", "st")
    return d.select("category", "id", F.size("st").cast("bigint").alias("n_statements"))


@query("statement_dir_counts", sql=_TURN_FILES_SQL + """
SELECT category, count(*)::BIGINT AS n_files, sum(n_statements)::BIGINT AS n_statements FROM f GROUP BY category
""")
def statement_dir_counts(spark, sf_dir):
    """S7 counts per category over the rows layout, written as a JSON report (S16) and read back."""
    root = SF.scratch_path(spark, "statements")
    SF.write_statement_dir(_turn_files(spark, sf_dir), root)
    d = extract.with_numbered_statements(SF.read_statement_rows(spark, root), "text", "st")
    counts = SF.count_files(d).join(
        d.groupBy("category").agg(F.sum(F.size("st")).cast("bigint").alias("n_statements")), "category")
    report = SF.scratch_path(spark, "report")
    SF.write_report(counts, report)
    return spark.read.schema("category string, n_files bigint, n_statements bigint").json(report)


# M14 F12 F13 M15 S9 over JSONL chat rows -------------------------------------------------------
@query("chat_rows_jsonl", sql=f"""
WITH c AS (
  SELECT conv_id,
         count(*) FILTER (WHERE {"trim(coalesce(role, '')) <> ''"}) AS n_turns,
         sum(length(coalesce(text, 'None'))) FILTER (WHERE {"trim(coalesce(role, '')) <> ''"}) AS turn_chars,
         arg_min(role, turn) AS first_role
  FROM conversations GROUP BY conv_id),
m AS (SELECT *, '[METADATA]' || chr(10) || '{{"conv_id": ' || conv_id || ', "source": "conversations"}}' AS md,
             coalesce(first_role, '') <> 'system' AS inject FROM c),
r AS (SELECT conv_id, (n_turns + CASE WHEN inject THEN 1 ELSE 0 END)::BIGINT AS n_messages,
             (coalesce(turn_chars, 0) + CASE WHEN inject THEN length(md) ELSE 0 END)::INTEGER AS char_len FROM m)
SELECT conv_id, n_messages, char_len,
       CASE WHEN char_len < 4096 THEN 1 WHEN char_len < 8192 THEN 2 ELSE 3 END AS stage FROM r
""")
def chat_rows_jsonl(spark, sf_dir):
    """Conversations written as JSONL message rows (metadata object per row),
    normalised back into chat rows and cached as zstd Parquet by stage."""
    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    msgs = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    md = F.struct(F.col("conv_id"), F.lit("conversations").alias("source"))
    line = F.to_json(F.struct(F.col("conv_id").alias("id"), msgs.alias("messages"), md.alias("metadata")),
                     {"ignoreNullFields": "false"})
    path = SF.scratch_path(spark, "chat_jsonl")
    per.select(line.alias("value")).write.mode("overwrite").text(path)
    lines = SJ.read_lines(spark, path).withColumn("conv_id", F.get_json_object("line", "$.id").cast("bigint"))
    rows = chat.with_length_stage(chat.chat_rows_from_lines(lines, keep=["conv_id"]))
    cache = SF.scratch_path(spark, "chat_cache")
    SF.write_parquet(rows, cache, partition_by=["stage"])
    out = spark.read.parquet(cache)
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), "char_len", "stage")
