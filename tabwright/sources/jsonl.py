"""JSONL sources and sinks.

Lines are read with the text source (splittable for plain files; ``.gz``,
``.bz2`` and ``.zst`` decompress through the Hadoop codecs, one task per
file); bytes that are no UTF-8 are dropped in the JVM.  A line's validity is
decided apart from its typing: a valid line becomes a Variant ``record`` that
holds every field, declared ones are read from it as typed columns, and the
others travel in an ``extra`` map, so neither a mistyped nor an unknown field
loses anything.  Bad lines are data, not crashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions.strict_json import canonical_json
from ..functions.text import drop_undecodable, py_strip

EXTRA = "extra"


class StrictJsonError(ValueError):
    pass


def _struct(schema: TY.StructType | str) -> TY.StructType:
    return TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# Lines -------------------------------------------------------------------------------
_META = ("file_path", "file_name", "file_block_start")


def _scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.text(paths if isinstance(paths, list) else [paths])
    return df.select("value", *[F.col(f"_metadata.{m}").alias(m) for m in _META])


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw lines with their file path (S3/S4: codec chosen by suffix, undecodable bytes dropped)."""
    return _scan(spark, paths).select(drop_undecodable("value").alias("line"), "file_path", "file_name")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line, blank ones too, with its 1-based line number within its file.

    A distributed prefix sum over file splits.  The lines of a split lie in one
    partition in file order, so ``monotonically_increasing_id`` numbers them
    without gaps.  One aggregation gives each split (file, block start) its first
    id and its number of lines, a running sum over a file's splits in block order
    gives the lines before it, and both are joined back by split.  The small
    relation has one row per split; no line is shuffled where it is broadcast.
    Both scans pack splits alike, as they plan the same files in one query.
    """
    at = F.monotonically_increasing_id()
    split = ["file_path", "file_block_start"]
    sizes = (_scan(spark, paths).select(*split, at.alias("at")).groupBy(*split)
             .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    lines = _scan(spark, paths).withColumn("at", at)
    return lines.join(shift, split).select("file_path", "file_name", (F.col("at") + F.col("shift")).alias("line_no"),
                                           drop_undecodable("value").alias("line"))


# Records -----------------------------------------------------------------------------
def with_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Non-blank lines with ``record`` (Variant, null when the line is no JSON) and ``bad``.

    Spark's JSON parser stops at the end of the first value.  Each line is put into
    an array before the digest of itself; only a line that is exactly one value
    leaves the digest as the second element.  What the parser refuses is looked at
    again by the standard library's (NaN, repeated keys: the last one counts), which
    decides; valid lines are not sent to Python.
    """
    s = py_strip(F.col(line_col))
    x = lines.filter(F.coalesce(s, F.lit("")) != "").withColumn("_s", s).withColumn("_digest", F.md5("_s"))
    x = x.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), F.col("_s"), F.lit(',"'), F.col("_digest"), F.lit('"]'))))
    whole = F.coalesce(F.try_variant_get("_v", "$[1]", "string") == F.col("_digest"), F.lit(False))
    x = x.withColumn("_again", canonical_json(F.when(~whole, F.col("_s"))))
    record = F.when(whole, F.try_variant_get("_v", "$[0]", "variant")).otherwise(F.try_parse_json("_again"))
    return x.withColumn("bad", ~whole & F.col("_again").isNull()).withColumn("record", record).drop(
        "_s", "_digest", "_v", "_again")


def _path(parent: str, name: str) -> str:
    return f"{parent}['{name}']" if "'" not in name else f'{parent}["{name}"]'


def typed(record: Column, dtype: TY.DataType, path: str = "$") -> Column:
    """The value at ``path`` of a Variant as ``dtype``, null where it does not convert without loss.

    Structs and arrays are read field by field and element by element, so a
    mistyped part loses that part only.  Text is any scalar's text, and the JSON text
    of an object or array.
    """
    if isinstance(dtype, TY.StructType):
        there = F.schema_of_variant(F.try_variant_get(record, path, "variant")).startswith("OBJECT")
        fields = [typed(record, f.dataType, _path(path, f.name)).alias(f.name) for f in dtype.fields]
        return F.when(there, F.struct(*fields))
    if isinstance(dtype, TY.ArrayType):
        return F.transform(F.try_variant_get(record, path, "array<variant>"), lambda v: typed(v, dtype.elementType))
    if isinstance(dtype, TY.IntegralType):
        whole = F.try_variant_get(record, path, dtype.simpleString())
        exact = F.try_variant_get(record, path, "decimal(38,18)")
        return F.when(exact.isNull() | (exact == whole), whole)
    return F.try_variant_get(record, path, dtype.simpleString())


def with_fields(records: DataFrame, schema: TY.StructType | str, record_col: str = "record") -> DataFrame:
    """Declared fields as typed columns beside the other columns, and ``extra``: all others as map of Variants."""
    st = _struct(schema)
    known = [f.name for f in st.fields]
    cols = [typed(F.col(record_col), f.dataType, _path("$", f.name)).alias(f.name) for f in st.fields]
    every = F.try_variant_get(F.col(record_col), "$", "map<string,variant>")
    extra = F.map_filter(every, lambda k, _: ~k.isin(known)) if known else every
    keep = [c for c in records.columns if c not in known and c != EXTRA]
    return records.select(*cols, extra.alias(EXTRA), *keep)


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Numbered non-blank lines: ``file_path``, ``file_name``, ``line_no``, ``line``, ``record``, ``bad``."""
    return with_records(numbered_lines(spark, paths))


def with_default_id(records: DataFrame, id_field: str = "id", out_col: str = "id") -> DataFrame:
    """The record's own id as text, else its zero-based line number; a null id stays null."""
    own = F.try_variant_get("record", _path("$", id_field), "variant")
    text = F.try_variant_get("record", _path("$", id_field), "string")
    return records.withColumn(out_col, F.when(own.isNull(), (F.col("line_no") - 1).cast("string")).otherwise(text))


def read_jsonl_lenient(spark: SparkSession, paths: str | list[str], schema: TY.StructType | str,
                       observation: Observation | None = None) -> DataFrame:
    """Blank and unparseable lines are skipped silently.

    ``observation`` gets ``n_lines`` (not blank) and ``n_bad`` when the result is computed.
    """
    p = with_records(read_lines(spark, paths))
    if observation is not None:
        p = p.observe(observation, F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_bad"))
    return with_fields(p.filter(~F.col("bad")), schema).drop("line", "record", "bad")


def jsonl_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S2 reject relation: ``(file_path, line_no, line)`` of malformed non-blank lines."""
    return read_records(spark, paths).filter("bad").select("file_path", "line_no", "line")


def read_jsonl_strict(spark: SparkSession, paths: str | list[str], schema: TY.StructType | str) -> DataFrame:
    """Fail on the first malformed line with ``path:line``; else the records."""
    p = with_records(read_lines(spark, paths))
    if not p.filter("bad").isEmpty():
        first = jsonl_rejects(spark, paths).orderBy("file_path", "line_no").first()
        raise StrictJsonError(f"{first['file_path']}:{first['line_no']}: invalid JSON")
    return with_fields(p, schema).drop("line", "record", "bad")


# Sinks -------------------------------------------------------------------------------
def json_line(df: DataFrame, extra_col: str | None = EXTRA) -> Column:
    """One JSON object of a row: its columns, then the fields of ``extra_col``."""
    own = F.to_json(F.struct(*[c for c in df.columns if c != extra_col]), {"ignoreNullFields": "false"})
    if extra_col not in df.columns:
        return own
    pairs = F.transform(F.map_entries(extra_col), lambda e: F.concat(
        _json_key(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    more = F.concat_ws(",", pairs)
    return F.when(F.coalesce(more, F.lit("")) == "", own).when(own == "{}", F.concat(F.lit("{"), more, F.lit("}"))).otherwise(
        F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), more, F.lit("}")))


def _json_key(key: Column) -> Column:
    """A JSON string literal."""
    quoted = F.to_json(F.array(key))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def ascii_json(line: Column) -> Column:
    """A JSON text with every non-ASCII character as ``\\uXXXX``, surrogate pairs beyond the basic plane."""
    def escape(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        above = code - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(code < 0x10000, unit(code)).otherwise(pair)

    runs = F.regexp_extract_all(line, F.lit(r"([^\x00-\x7F]|[\x00-\x7F]+)"))     # a non-ASCII character each, or ASCII
    return F.when(line.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(
        runs, lambda r: F.when(r.rlike(r"^[\x00-\x7F]"), r).otherwise(escape(r))), "")).otherwise(line)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None,
                ascii_only: bool = False, extra_col: str | None = EXTRA) -> None:
    """One JSON object per line; non-ASCII kept as UTF-8, or escaped with ``ascii_only``.

    A map column named ``extra_col`` is written as fields of the object (P6); nulls are written.
    ``partition_by`` columns name folders and are not part of the lines.
    """
    parts = partition_by or []
    line = json_line(df.drop(*parts), extra_col)
    w = df.select((ascii_json(line) if ascii_only else line).alias("value"), *parts).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if parts:
        w = w.partitionBy(*parts)
    w.text(path)


def _fs_and_path(path: str):
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def write_text_zstd(df: DataFrame, path: str, col: str = "value") -> int:
    """Write one ``.zst`` text file per partition (Hadoop's zstd writer needs
    native code; this compresses in the task through Arrow's zstd stream).

    Each task attempt writes a private temporary file and renames it to the
    partition's final name when done, so a retried or speculative attempt
    never leaves a partial or duplicate file.  Returns the lines written.
    """
    import uuid

    import pyarrow as pa

    token = uuid.uuid4().hex[:8]
    fs, base = _fs_and_path(path.rstrip("/"))
    fs.create_dir(base, recursive=True)

    def write(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        final = f"{base}/part-{ctx.partitionId():05d}-{token}.txt.zst"
        tmp = f"{base}/_tmp-{ctx.partitionId():05d}-{ctx.attemptNumber()}-{uuid.uuid4().hex[:6]}"
        n = 0
        with pa.CompressedOutputStream(fs.open_output_stream(tmp, compression=None), "zstd") as out:
            for batch in batches:
                for v in batch.column(0):
                    out.write((v.as_py() or b"") + b"\n")
                    n += 1
        fs.move(tmp, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    res = df.select(F.col(col).cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0]
    return int(res or 0)


# Merged examples (the text + schema + gold table records both training stages start from).
MERGED_EXAMPLE_DDL = (
    "id string, split string, text string, "
    "schema struct<table_id:string,columns:array<struct<name:string,path:array<string>>>,n_cols:int>, "
    "schema_signature string, "
    "table struct<table_id:string,columns:array<struct<name:string,path:array<string>>>,"
    "data:array<array<string>>>")


def read_merged_examples(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    """Merged examples from JSONL (plain or compressed): lenient skips bad
    lines (S1), strict stops at the first with ``path:line`` (S2)."""
    reader = read_jsonl_strict if strict else read_jsonl_lenient
    return reader(spark, paths, MERGED_EXAMPLE_DDL)
