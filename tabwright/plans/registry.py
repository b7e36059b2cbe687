"""Registry of named queries over the driver tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; an optional DuckDB SQL
string over the same tables is its oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import is_remote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


MIN_BYTES_PER_PARTITION = 512 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    When its scan yields fewer input splits than the session has cores (a
    small single-file table: one Parquet row group is one task), rows are
    spread round-robin so per-row work runs in parallel: over the cores, but
    never more than one partition per ~512 KB of input, so a tiny table on a
    large cluster does not become thousands of empty tasks.  Tables already
    split at least that finely, as any cluster-sized table is, are read as
    they are, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if is_remote():                                  # no plan access through Spark Connect
        return df
    plan = df._jdf.queryExecution()
    splits = plan.toRdd().getNumPartitions()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    target = min(spark.sparkContext.defaultParallelism, max(1, -(-size // MIN_BYTES_PER_PARTITION)))
    return df.repartition(target) if target > splits else df
