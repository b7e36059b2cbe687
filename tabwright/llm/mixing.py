"""Mixing sources to target token weights with hash-threshold histograms.

A document's hash (32 bits of the md5 of id and text) places it in its source's
order once and for all.  A source's budget is some whole passes plus a rest.
Word sums by source and 8-bit hash bucket show in which bucket the rest ends;
only that bucket is split by the next 8 bits, four times.  The result is one
threshold per source, so budgets are nested: a larger budget takes every
document that a smaller one takes.  Documents are then filtered by comparing
hashes; nothing is sorted and no document is shuffled.

Everything is DataFrame functions; what is gathered is one row per source.

Defined cases: a null text has size 0; the null source is one source, ordered
last; with no words at all every target is 0; rows equal in id and text share
one hash, and where the threshold falls on such rows a share of them is taken
by row position (same input layout, same choice); other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_COPIES = 3
_LEVELS, _BITS = 4, 8
_POSITION = 1000003


def document_hash(id_col: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws("|", id_col.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight, at most 3 times the source.

    Water filling in closed form: sources are capped in order of cap / weight as
    long as the level of the others lies above.  Ranking the sources is one
    sort of one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", MAX_COPIES * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / F.sum("weight").over(here_on))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)) \
        .select("source", "source_size", "target")


def thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``passes``, ``threshold``, ``tie_share``."""
    common.prepare(docs.sparkSession)
    sized = common.stage(docs.select(
        F.col(source_col).alias("source"), common.words_column(F.col(text_col)).alias("size"),
        document_hash(F.col(id_col), F.col(text_col)).alias("hash")), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_COPIES)))
    state = goal.withColumn("passes", F.coalesce(passes, F.lit(0)).cast("long")) \
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")) \
        .withColumn("threshold", F.lit(0).cast("long"))
    for depth in range(1, _LEVELS + 1):
        state = common.stage(state, "thresholds")
        shift = _BITS * (_LEVELS - depth)
        known = common.broadcast_if_small(
            state.select(F.col("source").alias("s"), "threshold"), 64)
        bucket = F.shiftright("hash", shift)
        hist = (sized.join(known, F.col("source").eqNullSafe(F.col("s"))
                           & (F.shiftright("hash", shift + _BITS) == F.col("threshold")))
                .groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
        state = state.withColumnRenamed("source", "s").drop("threshold", "words", "docs")
        hist = hist.join(state, F.col("source").eqNullSafe(F.col("s")))
        run = Window.partitionBy("source").orderBy("bucket")
        upto = F.sum("words").over(run)
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("bucket"))) == 1
        hist = hist.withColumn("upto", upto).withColumn("ends", (upto > F.col("rest")) | last).where("ends")
        first = F.row_number().over(run)
        hist = hist.withColumn("nth", first).where("nth = 1")
        state = hist.select(
            "source", "source_size", "target", "passes",
            (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"),
            F.col("bucket").alias("threshold"), "words", "docs")
    nearer = F.when(2 * F.col("rest") > F.col("words"), 1.0).otherwise(0.0)
    share = F.when((F.col("docs") == 1) | (F.col("words") == 0), nearer).otherwise(F.col("rest") / F.col("words"))
    return common.stage(state.select("source", "source_size", "target", "passes", "threshold", share.alias("tie_share")),
                        "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``row`` (the input row as a struct) and ``mix``: size, source_size, target and copies (how often the mix takes it)."""
    plan = thresholds(docs, id_col, text_col, source_col, weights)
    plan = common.broadcast_if_small(plan.select(F.struct("*").alias("__plan")), 96)
    rows = docs.select(F.struct("*").alias("row"))
    text, source = F.col("row").getField(text_col), F.col("row").getField(source_col)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_POSITION)) / _POSITION
    hashed = rows.withColumns({"hash": document_hash(F.col("row").getField(id_col), text), "place": place})
    joined = hashed.join(plan, source.eqNullSafe(F.col("__plan.source")), "left")
    over = (F.col("hash") < F.col("__plan.threshold")) | (
        (F.col("hash") == F.col("__plan.threshold")) & (F.col("place") < F.col("__plan.tie_share")))
    return joined.select("row", F.struct(
        common.words_column(text).alias("size"), F.col("__plan.source_size"), F.col("__plan.target"),
        (F.col("__plan.passes") + over.cast("long")).alias("copies")).alias("mix"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each document as many times as the mix takes it, input columns only."""
    taken = mix(docs, id_col, text_col, source_col)
    times = F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))
    return taken.select("row", F.explode(times)).select("row.*")
