"""Best-fit packing of token ids into sequences by exact-complement hashing.

Each text is encoded, with the end id appended; one longer than a sequence is cut
into pieces of the sequence's length, the first of which may be shorter.  Only how
many pieces of each length there are decides the packing, at most ``capacity``
numbers.  From these counts a plan is made: the longest length left opens a
sequence, and its gap is looked up among the sums of one, two and three lengths
that are left (sum tables, tested against the counts); a combination that fills the
gap exactly is taken as often as the counts allow.  Lengths without an exact
complement are packed best-fit: the largest sum of up to three lengths that fits,
again and again until nothing fits.  A step of the plan is a pattern of lengths and
how many sequences have it; every step takes a length's count below what the pattern
needs, so the plan grows with the number of lengths, never with the rows.

Spark numbers the pieces of each length (counts by length and written part, running
sums over parts), and a piece's number gives its sequence and place.

Defined cases: null and empty texts are the end id alone; rows with equal or null
ids are packed each for itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pieces

CAPACITY, END_ID = 1024, 2
_OUT_ROWS = 1 << 16
_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, k long"


@dataclass
class Step:
    """``times`` sequences, each holding ``count`` pieces of each length in ``runs`` (length, count)."""
    runs: list[tuple[int, int]]
    times: int


class Counts:
    """How many pieces of each length are left, with the sums that one, two and three of them reach."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.index()

    def index(self) -> None:
        """Sum tables of single lengths and of pairs; a triple is a single and a pair."""
        self.single = self.left > 0
        lengths = np.flatnonzero(self.single)
        self.pair = np.zeros(self.capacity + 1, bool)
        for x in lengths.tolist():
            self.pair[x:] |= self.single[: self.capacity + 1 - x]
        self.triple = np.zeros(self.capacity + 1, bool)
        for x in lengths.tolist():
            self.triple[x:] |= self.pair[: self.capacity + 1 - x]

    def enough(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def reached(self, terms: int) -> np.ndarray:
        """Whether a total is a sum of at most ``terms`` lengths."""
        return self.single | (self.pair if terms > 1 else False) | (self.triple if terms > 2 else False)

    def fill(self, total: int, used: list[int], terms: int) -> list[int] | None:
        """At most ``terms`` lengths that add up to ``total`` and are left beside ``used``; even combinations first."""
        def free(more):
            return self.enough(used + more)

        if self.single[total] and free([total]):
            return [total]
        if terms > 1 and self.pair[total]:
            x = np.arange((total + 1) // 2, total)
            for a in x[self.single[x] & self.single[total - x]].tolist():
                if free([a, total - a]):
                    return [a, total - a]
        if terms > 2 and self.triple[total]:
            x = np.arange((total + 2) // 3, total - 1)
            for a in x[self.single[x] & self.pair[total - x]].tolist():
                rest = total - a
                y = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
                for b in y[self.single[y] & self.single[rest - y]].tolist():
                    if free([a, b, rest - b]):
                        return [a, b, rest - b]
        return None

    def take(self, lengths: list[int]) -> Step:
        runs = [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]
        times = min(int(self.left[x]) // n for x, n in runs)
        for x, n in runs:
            self.left[x] -= n * times
        if any(self.left[x] == 0 for x, _ in runs):
            self.index()
        return Step(runs, times)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Patterns that use up all the counted lengths.

    Exact sums of three leave fewer short pieces for long ones that have no exact
    complement, so plans with sums of at most three, two and one are compared and
    the one with the fewest sequences is taken.
    """
    plans = [packed(counts, capacity, terms) for terms in (3, 2, 1)]
    return min(plans, key=lambda steps: sum(s.times for s in steps))


def packed(counts: dict[int, int], capacity: int, terms: int) -> list[Step]:
    """A plan: exact complements of at most ``terms`` lengths first, then best-fit."""
    c, steps = Counts(counts, capacity), []
    for exact in (True, False):
        for length in range(capacity, 0, -1):
            while c.left[length]:
                lengths, gap = [length], capacity - length
                while gap:
                    reach = np.flatnonzero(c.reached(terms)[: gap + 1])[::-1]
                    if exact:
                        reach = reach[:1][reach[:1] == gap]
                    more = next((m for m in (c.fill(t, lengths, terms) for t in reach.tolist()) if m), None)
                    if more is None:
                        break
                    lengths += more
                    gap -= sum(more)
                if exact and gap:
                    break
                steps.append(c.take(lengths))
    return steps


def slots(steps: list[Step]) -> np.ndarray:
    """Rows (length, first number, pieces a sequence, first sequence, offset of the first), by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for step in steps:
        offset = 0
        for length, n in step.runs:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * step.times
            offset += length * n
        sequence += step.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(n: int, capacity: int) -> list[int]:
    """Where a text of n ids is cut: all pieces but the first have full length."""
    first = n - (n - 1) // capacity * capacity
    return [0, *range(first, n + 1, capacity)]


def _cut_pieces(path: str, end_id: int, capacity: int):
    """Batches of (doc_id, text) to rows of pieces, each with its number among the equally long ones of this part."""
    def rows(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = pieces.byte_encoder(path)
        seen = [0] * (capacity + 1)
        out = tuple([] for _ in range(6))

        def flush():
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            cols = [pa.array(v, t) for v, t in zip(out, types)]
            cols.insert(5, pa.array(np.full(len(out[0]), part, np.int32)))
            for v in out:
                v.clear()
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, chunk in pieces.chunks(batch.column(1)):
                ids, bounds = enc.encode(chunk)
                ids = ids.astype("<u4")
                bounds = bounds.tolist()
                for row in range(len(chunk)):
                    lo, hi = bounds[row], bounds[row + 1]
                    at = cut(hi - lo + 1, capacity)
                    for k in range(len(at) - 1):
                        a, b = at[k], at[k + 1]
                        crc = zlib.crc32(ids[lo + a : min(lo + b, hi)].tobytes())
                        if k == len(at) - 2:
                            crc = zlib.crc32(end_id.to_bytes(4, "little"), crc)
                        for column, v in zip(out, (docs[first + row], k, a, b - a, crc, seen[b - a])):
                            column.append(v)
                        seen[b - a] += 1
                        if len(out[0]) >= _OUT_ROWS:
                            yield flush()
        if out[0]:
            yield flush()
    return rows


def _placed(table: np.ndarray):
    stride = 1 << 40                                   # numbers within a length stay below

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        size, k = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, number))
        row = table[np.searchsorted(table[:, 0] * stride + table[:, 1], size * stride + k, side="right") - 1]
        k = k - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + k // row[:, 2]),
                                           pa.array(row[:, 4] + size * (k % row[:, 2]))], ["sequence_id", "offset"])
    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut_rows = common.stage(rows.mapInArrow(_cut_pieces(tokenizer, end_id, capacity), _PIECE), "pack-pieces")
    by_part = common.stage(cut_rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()          # at most ``capacity`` rows
    if not totals:
        return cut_rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                               F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = slots(plan({r.length: r.n for r in totals}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut_rows.join(common.broadcast_if_small(bases, 24), ["length", "part"])
    place = _placed(table)(F.col("length"), F.col("base") + F.col("k"))
    return numbered.withColumn("place", place).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "place.sequence_id", "place.offset")
