"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside Arrow UDFs: ``bytes.lower`` folds exactly
A-Z, and ``bytes.split`` splits exactly on 0x09-0x0D and 0x20.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import ensure_checkpoint_dir, ship_package

#: A table is broadcast only when its rows were counted and fit in this many bytes.
BROADCAST_BYTES = 32 << 20
#: Arrow batches sent to Python hold at most this many bytes of column data; the smaller bound is for
#: operators whose workers hold several times a batch.
ARROW_BATCH_BYTES, SMALL_BATCH_BYTES = 16 << 20, 4 << 20


def prepare(spark: SparkSession, batch_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Ship the package to the executors and bound the Arrow batches by bytes."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder.

    The folders are grouped by application, so the retention of the checkpoint
    folder clears them.
    """
    app = spark.sparkContext.applicationId
    return f"{ensure_checkpoint_dir(spark)}/tabwright-llm-{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for ``df`` when its counted rows fit in ``limit`` bytes.

    Beyond that the join stays a shuffle join, which AQE splits where skewed.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Bits of a membership filter: 8 MB are broadcast, whatever the number of rows.
FILTER_BITS = 26


def _filter_cell(columns: list[Column]) -> Column:
    return F.xxhash64(*columns).bitwiseAND((1 << FILTER_BITS) - 1) + 1        # Spark's buckets count from 1


def member_filter(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A bitmap of the hashed ``columns`` of ``rows``, as at most 2,048 rows (bucket, 4 KB of bits)."""
    cell = _filter_cell([F.col(c) for c in columns])
    bits = (rows.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    return stage(bits, name)


def may_be_member(df: DataFrame, bits: DataFrame, columns: list[Column], flag: str) -> DataFrame:
    """``df`` with ``flag``: false where its row is certainly not in the filter's rows.

    A chance hit only sends a row through a join in vain.
    """
    cell = _filter_cell(columns)
    at = F.bitmap_bit_position(cell)
    small = bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    joined = df.join(F.broadcast(small), F.bitmap_bucket_number(cell) == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop("__bucket", "__bits")


def text_chunks(arr: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, list]]:
    """(start row, list of bytes) runs of a string array, each run near ``max_bytes``.

    Nulls come out as ``None``.  A longer single text is a run of its own.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.binary()) if not pa.types.is_binary(arr.type) else arr
    start, size, run = 0, 0, []
    for i, b in enumerate(arr.to_pylist()):
        run.append(b)
        size += len(b) if b is not None else 0
        if size >= max_bytes:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Elements handled at once by window_argmin; its tie-break code has 24 bits.
_SEGMENT = 1 << 23


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each start i, the position of the rightmost minimum of h[i : i + w].

    Compares the top 40 bits of the hashes; equal ones go to the right, a rule
    that depends on the content of the window alone.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for s in range(0, n, _SEGMENT):
        e = min(n, s + _SEGMENT)
        seg = h[s : e + w - 1]
        code = np.uint64((1 << 24) - 1) - np.arange(len(seg), dtype=np.uint64)
        m = (seg & ~np.uint64((1 << 24) - 1)) | code
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < w:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        out[s:e] = s + ((1 << 24) - 1 - (m & np.uint64((1 << 24) - 1))).astype(np.int64)
    return out


def rolling(h: np.ndarray, n: int, mult: int) -> np.ndarray:
    """Polynomial hash of every n consecutive elements, as mixed 64-bit values."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:k].copy()
    m = np.uint64(mult)
    for j in range(1, n):
        acc *= m
        acc += h[j : j + k]
    return mix64(acc)


def row_hash(id_col: Column, text: Column) -> Column:
    """Key of a row's content; rows with equal id and text share it and share every verdict."""
    return F.xxhash64(id_col, text)


def without(df: DataFrame, id_col: str, text_col: str, rejected: DataFrame, kind: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose (id, row hash) is not in ``rejected`` (columns ``bad_id``, ``bad_hash``).

    With ``left_semi`` the others.  A row travels as one struct, so its column names clash with none.
    """
    rows = df.select(F.struct("*").alias("row"))
    ident = F.col("row").getField(id_col)
    cond = ident.eqNullSafe(F.col("bad_id")) & (row_hash(ident, F.col("row").getField(text_col)) == F.col("bad_hash"))
    return rows.join(broadcast_if_small(rejected, 32), cond, kind).select("row.*")


def words_column(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
