"""Folder layouts, routing by file name, Parquet caches and report sinks
(S5-S10, S13-S16)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import ensure_checkpoint_dir
from .jsonl import _fs_and_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabwright-scratch/{name}-{uuid.uuid4().hex[:12]}"


# S5 / S6 / S7 -------------------------------------------------------------------------
def _plain_path(spark: SparkSession, path: str) -> str:
    """The absolute path of a file or folder without scheme and host, as it is named (not percent-encoded)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()


def read_statement_dir(spark: SparkSession, root: str) -> DataFrame:
    """S5 + S6: statement files, one per id, in either layout:

    * ``<root>/<category>/<id>.txt`` and ``<root>/<id>.txt`` (one file per id), or
    * ``<root>/folder=<category>/id=<id>/*.txt`` and ``<root>/id=<id>/*.txt``
      (Spark's partitioned layout).

    Returns ``(folder, category, id, text)``: ``folder`` is the raw
    sub-folder ('' for root files), ``category`` its F7 display name; root
    files form ``Team`` only when there is no ``team`` folder.  Each file is
    one row (``wholetext``); files are small, one per id.  File URLs and escaped
    partition values are decoded, so names and the root may hold blanks,
    percent signs and any letters, partition values slashes too.
    """
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
          .text(root, wholetext=True))
    base = _plain_path(spark, root).rstrip("/") + "/"
    path = T.percent_decoded(F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][\w+.-]*:(//[^/]*)?(?=/)", ""))
    df = df.select(F.col("value"), path.alias("path")).filter(F.startswith("path", F.lit(base)))
    parts = F.split(F.substring("path", len(base) + 1, 1 << 30), "/", -1)
    value = lambda p: T.percent_decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    id_seg = F.filter(parts, lambda p: F.startswith(p, F.lit("id=")))
    hive = F.size(id_seg) > 0
    ident = F.when(hive, value(F.get(id_seg, F.lit(0)))).otherwise(
        F.regexp_replace(F.element_at(parts, -1), r"(?s)(?<=.)\.[^.]*$", ""))
    first = parts[0]
    folder = (F.when(hive & F.startswith(first, F.lit("folder=")), value(first))
              .when(~hive & (F.size(parts) > 1), first).otherwise(F.lit("")))
    depth_ok = F.when(hive, F.size(parts) <= 3).otherwise(F.size(parts) <= 2)
    x = df.select(folder.alias("folder"), ident.alias("id"), T.drop_undecodable("value").alias("text"),
                  depth_ok.alias("_ok")).filter("_ok").drop("_ok")
    return _categories(x)


def count_files(statements: DataFrame) -> DataFrame:
    """Files per category."""
    return statements.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))


#: What partition folders escape, and how they name a missing or empty value.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(0x01, 0x20), *map(ord, "\"#%'*/:=?\\{[]^"), 0x7F]}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_statement_files(df: DataFrame, path: str, folder_col: str = "folder", id_col: str = "id",
                          text_col: str = "text", order_col: str | None = None) -> None:
    """S15 as files: ``<path>/folder=<folder>/id=<id>/part-*.txt``, one per (folder, id); a null folder is the root.
    Rows of one file follow ``order_col``, nulls last.

    The layout and escapes are those of ``partitionBy(folder, id).text(...)``, and so is a
    file's text: each row and a line break.  That writer is not used as it commits each
    file from the driver and, on a local disk, starts processes to set the modes of each
    new file and folder; here a task renames its own files to names that its retries share.
    """
    fs, base = _fs_and_path(path.rstrip("/"))
    fs.create_dir(base, recursive=True)
    token = uuid.uuid4().hex[:8]
    spark = df.sparkSession
    folder, ident = F.col(folder_col), F.col(id_col).cast("string")
    x = df.select(F.when(folder == "", F.lit(_NO_VALUE)).otherwise(folder).alias("folder"),
                  F.when(ident != "", ident).otherwise(F.lit(_NO_VALUE)).alias("id"),
                  F.col(text_col).cast("binary").alias("text"),
                  (F.col(order_col) if order_col else F.lit(0)).alias("order"))
    # the number is given, so that few bytes in many files are not coalesced into few tasks
    x = x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder", "id")
    x = x.sortWithinPartitions("folder", "id", F.col("order").asc_nulls_last()).drop("order")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        final = f"part-{ctx.partitionId():05d}-{token}.txt"
        tmp = f".{final}-{ctx.attemptNumber()}-{uuid.uuid4().hex[:6]}"
        n, key, out, at = 0, None, None, base

        def close():
            if out is not None:
                out.close()
                fs.move(f"{at}/{tmp}", f"{at}/{final}")

        for batch in batches:
            for folder, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or key != (folder, ident):
                    close()
                    key, n = (folder, ident), n + 1
                    named = ([] if folder is None else [("folder", folder)]) + [("id", ident)]
                    at = "/".join([base, *(f"{k}={v.translate(_ESCAPED)}" for k, v in named)])
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{tmp}", compression=None)
                out.write((text or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    x.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    with fs.open_output_stream(f"{base}/_SUCCESS"):
        pass


def write_statement_dir(df: DataFrame, path: str, category_col: str = "category", id_col: str = "id",
                        text_col: str = "text") -> None:
    """Statement texts per (category, id) as JSON rows ``(id, text)``; a null category is the root.

    Partitioned by ``folder=<F8 name>`` (``folder=__root__`` for the root), read back by
    :func:`read_statement_rows`.  Ids are data, so any text is one; a folder per id would
    make as many files as rows.
    """
    x = df.select(F.coalesce(T.safe_table_name(category_col), F.lit(ROOT_FOLDER)).alias("folder"),
                  F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    x.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("folder").json(path)


ROOT_FOLDER = "__root__"


def read_statement_rows(spark: SparkSession, root: str) -> DataFrame:
    """S5 + S6 over the rows layout: ``(folder, category, id, text)``, same rules."""
    x = spark.read.schema("id string, text string, folder string").json(root)
    x = x.withColumn("folder", F.when(F.col("folder") == ROOT_FOLDER, F.lit("")).otherwise(F.col("folder")))
    return _categories(x.select("folder", "id", "text"))


def _categories(x: DataFrame) -> DataFrame:
    """Display names; root rows form ``Team`` unless a folder does.  ``x`` is read twice: for its rows, and for one
    row of such a folder, which is broadcast (rows of one category are never dealt to one task)."""
    root = F.col("folder") == ""
    named = x.withColumn("category", F.when(root, F.lit("Team")).otherwise(T.category_display_name("folder")))
    team = named.filter(~root & (F.col("category") == "Team")).select(F.col("category").alias("_team")).limit(1)
    return named.join(F.broadcast(team), root & (F.col("category") == F.col("_team")), "left_anti")


#: What Spark says of a path without rows: missing, without Parquet files, or with files that are none.
_NO_ROWS = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


# S8 / S9 / S10 --------------------------------------------------------------------------
def parquet_rows(spark: SparkSession, path: str) -> int:
    """Row count from the footers; 0 when the path is missing or holds no readable Parquet.

    Other errors (a lost store, a failed job) are raised: they say nothing about the rows.
    """
    try:
        return spark.read.parquet(path).count()
    except (PySparkException, Py4JJavaError) as e:
        if any(reason in str(e) for reason in _NO_ROWS):
            return 0
        raise


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its ``_SUCCESS`` marker in ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Zstd Parquet."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


class EmptyCacheError(RuntimeError):
    pass


def materialize(build, spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Reuse ``path`` if a finished write left rows there, else (re)build it from ``build()``.

    A folder without the writer's commit marker is rebuilt; an error while
    reading a finished one is raised, not taken for an empty cache.

    ``build`` returns the DataFrame to persist.  With ``require_rows`` an
    empty result after the rebuild is an error.  Writing to the shared
    folder also cuts the lineage, so executors lost later recompute from
    the files, not from the start of the job.
    """
    if not committed(spark, path) or spark.read.parquet(path).isEmpty():
        write_parquet(build(), path)
    if require_rows and spark.read.parquet(path).isEmpty():
        raise EmptyCacheError(f"{path} still has 0 rows after rebuild")
    return spark.read.parquet(path)


# S13 / S14 --------------------------------------------------------------------------------
def split_from_name(name) -> Column:
    """Train / validation (or dev) / test / data from a file name, first hit wins."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.lit(K.SPLIT_DEFAULT)
    for split, words in reversed(K.SPLIT_RULES):
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(split)).otherwise(out)
    return out


def output_name(name) -> Column:
    """``<input>_stage2_messages`` after stripping ``.jsonl`` / ``.jsonl.gz``."""
    n = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.regexp_replace(n, r"\.jsonl\.gz$", ""), r"\.jsonl$", "")
    return F.concat(stem, F.lit("_stage2_messages"))


# S16 ---------------------------------------------------------------------------------------
def write_report(df: DataFrame, path: str) -> None:
    """Metrics report sink (small aggregated frames)."""
    df.write.mode("overwrite").json(path)
