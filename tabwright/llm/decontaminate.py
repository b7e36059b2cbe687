"""Benchmark decontamination by winnowing.

Every text becomes words ``[0-9a-z, bytes >= 0x80]+`` after folding A-Z.  Of each
span of ``window`` words the minimum ``kgram``-word hash (rightmost on ties) is
the fingerprint; consecutive spans with the same fingerprint form a run, which
carries the hashes of its spans.  Two equal spans always choose the same
fingerprint, so joining fingerprints finds every shared span; joining the spans
of the runs that met is the extension step.  An item shorter than ``window``
words is one span of its own length.

Defined cases: null or word-less texts have no words, no hits and are clean;
items without words never occur; repeated rows are judged one by one; null item
ids are not listed; an empty benchmark leaves every document clean; input
columns other than id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, KGRAM = 13, 5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MULT = 0x9E3779B97F4A7C15
_RUN = T.StructType([
    T.StructField("fp", T.LongType()), T.StructField("start", T.IntegerType()),
    T.StructField("len", T.IntegerType()), T.StructField("spans", T.ArrayType(T.LongType())),
])
_RUNS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))])


def word_hashes(text: bytes | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _span_runs(h: np.ndarray, ends: np.ndarray, window: int, kgram: int):
    """(run starts, fingerprints, span positions, span hashes, run offsets) of concatenated texts.

    ``ends`` gives, for every word, the end of its text; spans stay inside one.
    """
    spans = common.rolling(h, window, _MULT)
    at = np.flatnonzero(np.arange(len(spans)) + window <= ends[: len(spans)])
    grams = common.rolling(h, kgram, _MULT)
    low = common.window_argmin(grams, window - kgram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], grams[low[first]], spans[at], np.append(first, len(at))


def _runs_udf(window: int, kgram: int, lengths: list[int]):
    """UDF text -> (n_words, runs): a marker run (start -1) first, then the runs of the text."""

    @F.arrow_udf(_RUNS)
    def runs(texts: pa.Array) -> pa.Array:
        parts = [_chunk_runs([word_hashes(t) for t in chunk], window, kgram, lengths)
                 for _, chunk in common.text_chunks(texts)]
        empty = _chunk_runs([], window, kgram, lengths)
        return pa.concat_arrays(parts or [empty])

    return runs.asNondeterministic()   # evaluate once per row, however often it is referenced


def _chunk_runs(hashes: list[np.ndarray], window: int, kgram: int, lengths: list[int]) -> pa.StructArray:
    sizes = np.array([len(x) for x in hashes], np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    ends = np.repeat(stops, sizes)
    start, fp, span, offsets = _span_runs(h, ends, window, kgram)
    length = np.full(len(start), window)
    count = np.diff(offsets)
    for m in lengths:                      # spans of the short items' lengths, each its own fingerprint
        g = common.rolling(h, m, _MULT + 2 * m)
        at = np.flatnonzero(np.arange(len(g)) + m <= ends[: len(g)])
        start, fp, span = np.append(start, at), np.append(fp, g[at]), np.append(span, g[at])
        length, count = np.append(length, np.full(len(at), m)), np.append(count, np.ones(len(at), np.int64))
    owner = np.searchsorted(stops, start, side="right")
    n = len(sizes)
    owner = np.append(np.arange(n), owner)           # the marker runs sort first
    order = np.argsort(owner, kind="stable")
    begin = np.append(np.zeros(n, np.int64), np.cumsum(count) - count)
    count = np.append(np.zeros(n, np.int64), count)
    start = np.append(np.full(n, -1), start - begins[owner[n:]] if len(start) else start)
    length, fp = np.append(np.zeros(n, np.int64), length), np.append(np.zeros(n, np.uint64), fp)
    if lengths:                                      # spans follow their runs' new order
        at = np.repeat(begin[order], count[order])
        inner = np.arange(len(at)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
        span = span[at + inner]
    lists = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(count[order])), pa.int32()), pa.array(span.astype(np.int64, copy=False).view(np.int64)))
    rows = pa.StructArray.from_arrays(
        [pa.array(fp[order].view(np.int64)), pa.array(start[order], pa.int32()), pa.array(length[order], pa.int32()), lists],
        ["fp", "start", "len", "spans"])
    per_text = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=n)) if n else []).astype(np.int64), pa.int32())
    return pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(per_text, rows)], ["n_words", "runs"])


def _items(bench: DataFrame, item_col: str, text_col: str, window: int, kgram: int) -> tuple[DataFrame, list[int]]:
    """Spans of the items (fp, len, span, item), and the lengths of items below ``window`` words."""
    base = bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    n = base.select(_runs_udf(window, kgram, [])("text").alias("r")).select(F.col("r.n_words").alias("n"))
    short = [r.n for r in n.where(F.col("n").between(1, window - 1)).distinct().orderBy("n").collect()]  # < window rows
    runs = (base.select("item", _runs_udf(window, kgram, short)("text").alias("r"))
            .select("item", "r.n_words", F.explode("r.runs").alias("run"))
            .where(F.col("run.len") == F.least("n_words", F.lit(window))))
    spans = runs.select("item", "run.fp", "run.len", F.explode("run.spans").alias("span")).distinct()
    return spans, short


def hits(docs: DataFrame, bench: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """One row per document row: ``doc_id``, ``doc_hash``, ``n_words``, ``hits``, ``items``.

    ``hits`` are (start, len) of the item spans that occur, in words; ``items``
    the ids of the items they come from.
    """
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    spans, short = _items(bench, item_col, item_text_col, window, kgram)
    spans = common.stage(spans, "bench-spans")
    small = spans.count() * 64 <= common.BROADCAST_BYTES
    prints = spans.select("fp").distinct()
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_col).alias("doc_id"),
                        common.row_hash(F.col(doc_col), F.col(text_col)).alias("doc_hash"),
                        _runs_udf(window, kgram, short)(F.col(text_col)).alias("r"))
            .select("row", "doc_id", "doc_hash", "r.n_words", F.inline("r.runs")))
    if small:
        met = (rows.join(F.broadcast(prints.withColumn("met", F.lit(True))), "fp", "left")
               .where("met or start = -1").drop("met"))
        other = F.broadcast(spans)
    else:                                            # both sides shuffle; one evaluation of the UDF
        rows = common.stage(rows, "doc-runs")
        met = rows.where("start >= 0").join(prints, "fp", "left_semi").select(rows.columns).union(rows.where("start = -1"))
        other = spans
    each = met.select("row", "doc_id", "doc_hash", "n_words", "start", "len", F.posexplode_outer("spans").alias("k", "span"))
    found = each.join(other.select("span", "len", "item", F.lit(True).alias("hit")), ["span", "len"], "left")
    return (found.groupBy("row", "doc_id", "doc_hash").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct((F.col("start") + F.col("k")).alias("start"), "len"))).alias("hits"),
        F.collect_set(F.when(F.col("hit"), F.col("item"))).alias("items")).drop("row"))


def contamination(docs: DataFrame, bench: DataFrame, share: int = 20, **kw) -> DataFrame:
    """``hits`` with the number of hit words, and ``contaminated`` where they reach 1/``share`` of the words."""
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    return (hits(docs, bench, **kw).withColumn("n_hit", F.size(covered).cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def clean(docs: DataFrame, bench: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    bad = contamination(docs, bench, doc_col=doc_col, text_col=text_col).where("contaminated")
    bad = common.stage(bad.select(F.col("doc_id").alias("bad_id"), F.col("doc_hash").alias("bad_hash")), "contaminated")
    return common.without(docs, doc_col, text_col, bad)
