"""The largest share of a statement's tokens that one single other statement holds.

A top-1 set-overlap join on an inverted token index.  Within a scope (the id, or id
and category) tokens are ordered by how few of the other side's statements hold
them, and a statement looks up its rarest tokens first.  A statement of m indexed
tokens whose best match so far shares b, after its p rarest tokens were looked up,
can gain no more than m - p: it is settled once b reaches that, and only the
others look up the next tokens.  Statements shorter than b + 1 tokens are not
met again.  So common tokens are looked up only for statements without a good match among
the rare ones, and pairs without a common token never meet.  Equal token sets
of a scope are one statement meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_path, write_parquet

#: How many of its rarest tokens a statement has looked up after each round; the last round takes all.
ROUNDS = (2, 8, None)


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _classes(statements: DataFrame, scope: list[str], tokens: str, number: str) -> DataFrame:
    """Distinct token sets of each scope, numbered."""
    sets = statements.select(*scope, F.array_sort(tokens).alias("t")).filter(F.size("t") > 0).distinct()
    return _staged(sets.withColumn(number, F.monotonically_increasing_id()), "overlap-sets")


def best_overlap(statements: DataFrame, others: DataFrame, scope: list[str], tokens: str = "t",
                 out_col: str = "score") -> DataFrame:
    """``statements`` with ``out_col``: the best share of its (distinct) ``tokens`` in one of ``others`` of its scope.

    0 without tokens or without a match.
    """
    q, d = _classes(statements, scope, tokens, "q"), _classes(others, scope, tokens, "d")
    index = d.select(*scope, "d", F.size("t").alias("n"), F.explode("t").alias("tok"))
    held = index.groupBy(*scope, "tok").agg(F.count(F.lit(1)).alias("df"))
    rarest = (q.select(*scope, "q", F.explode("t").alias("tok")).join(held, [*scope, "tok"])
              .groupBy(*scope, "q").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("r"))
              .select(*scope, "q", F.transform("r", lambda x: x["tok"]).alias("r"), F.lit(0).alias("best")))
    state, done = _staged(rarest, "overlap-state"), 0
    for upto in ROUNDS:
        open_ = state.filter(F.col("best") < F.size("r") - done)
        part = F.slice("r", done + 1, F.lit(upto - done)) if upto else F.slice("r", F.lit(done + 1), F.size("r"))
        looked = open_.select(*scope, "q", "best", F.explode(part).alias("tok"))
        met = (looked.join(index, [*scope, "tok"]).filter(F.col("n") > F.col("best")).select("q", "d").distinct()
               .join(q.select("q", F.col("t").alias("a")), "q").join(d.select("d", F.col("t").alias("b")), "d"))
        found = met.groupBy("q").agg(F.max(F.size(F.array_intersect("a", "b"))).alias("found"))
        better = state.join(found, "q", "left").select(
            *scope, "q", "r", F.greatest("best", F.coalesce("found", F.lit(0))).alias("best"))
        state, done = _staged(better, "overlap-state"), upto or 0
    top = state.select("q", "best").join(q, "q").select(*scope, F.col("t").alias("_t"), "best")
    out = statements.withColumn("_t", F.array_sort(tokens)).join(top, [*scope, "_t"], "left")
    n = F.size("_t")
    return out.withColumn(out_col, _share(F.coalesce("best", F.lit(0)), n)).drop("_t", "best")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
