"""Removal of repeated byte strings by distributed prefix doubling.

A string of ``LENGTH`` bytes is repeated when it also starts elsewhere.  The rank of
a string is its fingerprint (two polynomial hashes modulo primes near 2**31), so
equal strings have equal ranks.  Spark sorts (position, rank, rank at an offset)
rows at growing offsets, positions whose pair of ranks is unique drop out, and the
others are ranked anew until the pair spans ``LENGTH`` bytes:

* Every start p is represented by the anchor a(p): the rightmost minimum of the
  16-byte hashes at p .. p + ``SPAN`` - 1.  It depends on the string at p alone,
  so equal strings have equal anchors.  Consecutive starts with one anchor form
  a run; a start's distance to its anchor is d.  Suffixes at anchors, about two in
  ``SPAN`` positions, are ranked by 100 bytes, then by the ranks at offsets 0 and
  100 (200 bytes), which lie inside every string of the run.
* Runs still tied whose whole text (first start to last start + 400) is repeated
  are settled.  The other ties are cut into blocks of ``BLOCK`` starts by d: a
  block's ranks of 200 bytes at offsets 0 and 193 (393 bytes inside all its
  strings) must be tied, and a block whose whole text is repeated is settled.
* Blocks still tied are cut into single starts, ranked by the ranks of 200 bytes
  at offsets 0 and 200.  Of equal settled runs and blocks one stands for all.
* Starts that are repeated at the full length cover the removed bytes.

Ranking every byte position from the first step sorts several rows per input
byte and several times over; anchors keep the result and cut the rows a
hundredfold.  Only runs whose ties are open carry their text on, 600 bytes each.

Defined cases: null text is the empty text; shorter texts than ``LENGTH`` are
kept whole; matches never cross rows; repeated rows are different documents;
texts of any length are read in segments; where a text repeats itself so closely
that runs are short, equal runs beyond two of a segment are settled at once; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, SPAN, GRAM, STEP = 400, 200, 16, 100
BLOCK = 8
_SEGMENT = 1 << 19
_RUN = T.StructType([
    T.StructField("lo", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("up", T.IntegerType()),
    T.StructField("r1", T.LongType()), T.StructField("r2", T.LongType()), T.StructField("whole", T.LongType())])
_PART = T.StructType([
    T.StructField("d", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("r1", T.LongType()),
    T.StructField("r2", T.LongType()), T.StructField("whole", T.LongType())])
_KEPT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType())])


class Rolling:
    """Hashes modulo 2**64 of all substrings of one length, to choose anchors; never taken for equality."""

    _letters = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64)

    def __init__(self, data: np.ndarray):
        self.h = self._letters[data]

    def every(self, n: int) -> np.ndarray:
        return common.rolling(self.h, n, 0x9E3779B97F4A7C15)


class Prints:
    """Fingerprints of any substrings of one byte array: 31 bits modulo each of two primes, from running sums."""

    _PRIMES = (2147483647, 2147483629)
    _tables: dict[tuple[int, int], tuple] = {}

    @classmethod
    def _powers(cls, seed: int, prime: int, n: int):
        held = cls._tables.get((seed, prime))
        if held is None or len(held[1]) < n:
            rng = np.random.default_rng([seed, prime])
            letter = rng.integers(1, prime, 256, np.uint64)
            base = int(rng.integers(1 << 20, prime - 1))
            tables = []
            for b in (base, pow(base, -1, prime)):
                t = np.ones(1, np.uint64)
                while len(t) < n:
                    t = np.concatenate([t, t * np.uint64(pow(b, len(t), prime)) % np.uint64(prime)])
                tables.append(t)
            held = cls._tables[seed, prime] = (letter, *tables)
        return held

    def __init__(self, data: np.ndarray, seed: int = 2):
        self.parts = []
        for prime in self._PRIMES:
            letter, up, down = self._powers(seed, prime, len(data) + 1)
            p = np.uint64(prime)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letter[data] * down[: len(data)] % p, out=total[1:])        # below 2**31 * bytes: no overflow
            self.parts.append((p, up, total))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for p, up, total in self.parts:
            out = (out << np.uint64(31)) | (total[end] - total[start]) % p * up[start] % p
        return out.view(np.int64)


def _segments(texts: list[bytes | None], length: int):
    """Batches of (text number, offset, bytes); a text's segments overlap so that each start is in one."""
    batch, size = [], 0
    for k, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for s in range(0, len(t) - length + 1, _SEGMENT):
            part = t[s : s + _SEGMENT + length - 1]
            batch.append((k, s, part))
            size += len(part)
            if size >= _SEGMENT:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def anchor_runs(batch, length: int, span: int):
    """Columns text number, lo, n, up, r1, r2, whole of the runs of some segments."""
    sizes = np.array([len(b) for _, _, b in batch])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
    low = common.window_argmin(Rolling(data).every(GRAM), span)
    at = np.arange(len(low))
    ok = at[at + length <= np.repeat(ends, sizes)[: len(low)]]
    anchor = low[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    lo, hi, a = ok[first], ok[last], anchor[first]
    seg = np.searchsorted(ends, lo, side="right")
    begin = (ends - sizes)[seg]
    step, prints = length // 4, Prints(data)
    return _thinned([np.array([k for k, _, _ in batch])[seg], lo - begin + np.array([s for _, s, _ in batch])[seg],
                     hi - lo + 1, a - lo, prints.at(a, a + step), prints.at(a + step, a + 2 * step),
                     prints.at(lo, hi + length)], np.bincount([k for k, _, _ in batch], sizes))


def _thinned(cols: list[np.ndarray], text_bytes: np.ndarray):
    """Where runs of a text are short, keeps two of each kind; the others come as merged runs without ranks (up -1)."""
    text = cols[0]
    crowded = np.flatnonzero(np.bincount(text, minlength=len(text_bytes)) * 16 > text_bytes)
    if not len(crowded):
        return cols
    rows = np.flatnonzero(np.isin(text, crowded))
    kind = [cols[c][rows] for c in (0, 2, 3, 4, 5, 6)]
    order = np.lexsort(kind[::-1])
    same = np.ones(len(order), bool)
    same[0] = False
    for k in kind:
        same[1:] &= k[order][1:] == k[order][:-1]
    third = order[2:][same[2:] & same[1:-1]]                # at least two equal ones stand before it
    spare = np.zeros(len(text), bool)
    spare[rows[third]] = True
    t, lo, n = (cols[c][spare] for c in (0, 1, 2))
    begin = np.ones(len(t), bool)
    begin[1:] = (t[1:] != t[:-1]) | (lo[1:] != (lo + n)[:-1])
    at = np.flatnonzero(begin)
    zero = np.zeros(len(at), np.int64)
    merged = [t[at], lo[at], np.add.reduceat(n, at) if len(at) else n, zero - 1, zero, zero, zero]
    out = [np.concatenate([c[~spare], m]) for c, m in zip(cols, merged)]
    order = np.argsort(out[0], kind="stable")
    return [c[order] for c in out]


def _runs_udf(length: int, span: int):
    @F.arrow_udf(T.ArrayType(_RUN))
    def runs(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.binary()).to_pylist()
        parts = [anchor_runs(b, length, span) for b in _segments(values, length)]
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7
        offsets = np.append(0, np.cumsum(np.bincount(cols[0], minlength=len(values)))) if len(values) else [0]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        fields = [pa.array(c).cast(t) for c, t in zip(cols[1:], types)]
        rows = pa.StructArray.from_arrays(fields, ["lo", "n", "up", "r1", "r2", "whole"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return runs


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _slices(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The [lo, hi) slices of a text."""
    return pa.array([[(t or b"")[s["lo"] : s["hi"]] for s in own or ()]
                     for t, own in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist())], pa.list_(pa.binary()))


def _parts_udf(length: int, block: int):
    """Blocks (by d, the distance to the anchor) of the starts d0, d0 - 1, .., of a slice that begins at d0.

    Per block: its largest d, its number of starts, the ranks of ``length / 2`` bytes at both
    ends of the bytes that all strings of a full block share, and the rank of its whole text.
    """
    half = length // 2

    @F.arrow_udf(T.ArrayType(_PART))
    def parts(slices: pa.Array, first: pa.Array, count: pa.Array) -> pa.Array:
        offsets, cols = [0], [[] for _ in range(5)]
        group, size = [], 0

        def flush():
            data = np.frombuffer(b"".join(t for t, _, _ in group), np.uint8)
            prints, at = Prints(data), 0
            for text, d0, n in group:
                high = np.arange(d0 // block, (d0 - n + 1) // block - 1, -1)             # block numbers, first starts first
                top = np.minimum(d0, high * block + block - 1)
                low = np.maximum(d0 - n + 1, high * block)
                core = at + d0 - high * block                                            # the block's last possible start
                shared = length + 1 - block
                for c, v in zip(cols, (top, top - low + 1, prints.at(core, core + half),
                                       prints.at(core + shared - half, core + shared),
                                       prints.at(at + d0 - top, at + d0 - low + length))):
                    c.append(v)
                offsets.append(offsets[-1] + len(high))
                at += len(text)
            group.clear()

        for text, d0, n in zip(slices.to_pylist(), first.to_pylist(), count.to_pylist()):
            group.append((text, d0, n))
            size += len(text)
            if size >= _SEGMENT:
                flush()
                size = 0
        if group:
            flush()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        rows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(t) for c, t in zip(cols, kinds)],
            ["d", "n", "r1", "r2", "whole"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return parts


def removed_spans(starts: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal [begin, end) byte ranges covered by strings that start in the (first, count) runs."""
    spans: list[list[int]] = []
    for lo, n in sorted(starts):
        end = lo + n - 1 + length
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    return spans


def _kept_udf(length: int):
    @F.arrow_udf(_KEPT)
    def kept(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.cast(pa.binary()).to_pylist(), starts.to_pylist()):
            text = text or b""
            spans = removed_spans([(r["lo"], r["n"]) for r in own or ()], length)
            digest, at = hashlib.sha256(), 0
            for b, e in spans:
                digest.update(text[at:b])
                at = e
            digest.update(text[at:])
            out.append({"n_bytes": len(text), "n_removed": sum(e - b for b, e in spans), "spans": spans,
                        "kept_sha256": digest.hexdigest()})
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                                        ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())]))

    return kept.asNondeterministic()


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur more than once: counted map-side, sifted by a filter, then a semi join."""
    twice = common.stage(rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "ranks")
    sifted = common.may_be_member(rows, common.member_filter(twice, keys, "rank-filter"), [F.col(k) for k in keys], "may")
    return sifted.where("may").drop("may").join(twice, keys, "left_semi")


_WHERE = ["doc_id", "doc_hash", "a"]


def _split(rows: DataFrame, core: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Settled rows of ``rows``, and one row of each class of the ties that are still open.

    A class holds rows with equal whole texts; one with two members is settled.  A tie
    (equal ``core``) is open if it holds several classes, one of them a single row.
    """
    same = [*core, "d", "n", "whole"]
    classes = common.stage(rows.groupBy(*same).agg(
        F.count("*").alias("c"), F.min(F.struct(*_WHERE, "settled")).alias("one")), f"{name}-classes")
    wide = classes.groupBy(*core).agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1")
    open_ = (classes.join(wide.select(*core), core, "left_semi")
             .select("one.doc_id", "one.doc_hash", "one.a", "d", "n",
                     ((F.col("c") > 1) | F.col("one.settled")).alias("settled")))
    done = rows.where("not settled").join(classes.where("c > 1").select(same), same, "left_semi")
    return done.select("doc_id", "doc_hash", (F.col("a") - F.col("d")).alias("lo"), "n"), common.stage(open_, f"{name}-open")


def repeated_starts(docs: DataFrame, key: list[Column], text: Column, length: int = LENGTH, span: int = SPAN,
                    unique: bool = False) -> DataFrame:
    """``doc_id``, ``doc_hash``, ``lo``, ``n``: runs of starts whose strings are repeated."""
    base = docs.select(*key, text.alias("text"))
    rows = common.stage(base.select("doc_id", "doc_hash", F.explode(_runs_udf(length, span)("text")).alias("r"))
                        .select("doc_id", "doc_hash", "r.*"), "anchors")
    found = rows.where("up < 0").select("doc_id", "doc_hash", "lo", "n")
    rows = rows.where("up >= 0").select("doc_id", "doc_hash", (F.col("lo") + F.col("up")).alias("a"), F.col("up").alias("d"),
                                        "n", "r1", "r2", "whole", F.lit(False).alias("settled"))
    tied = common.stage(_repeated(rows, ["r1"]), "tied-100")
    tied = common.stage(_repeated(tied, ["r1", "r2"]), "tied-200")
    done, open_ = _split(tied, ["r1", "r2"], "run")
    found = found.union(done)
    # the texts of open runs: from the first start to the end of the last one's string, but whole blocks at the end
    last = F.col("d") - F.col("n") + 1
    lists = open_.groupBy(F.col("doc_id").alias("i"), F.col("doc_hash").alias("h")).agg(F.collect_list(F.struct(
        (F.col("a") - F.col("d")).alias("lo"), (F.col("a") - last + length).alias("hi"), "a", "d", "n", "settled")).alias("runs"))
    lists = common.stage(lists, "run-lists")
    texts = (_only_listed(base, lists).join(lists, _same_row("i", "h"))
             .select("doc_id", "doc_hash", F.explode(F.arrays_zip("runs", _slices("text", "runs").alias("slice"))).alias("s"))
             .select("doc_id", "doc_hash", "s.runs.a", "s.runs.d", "s.runs.n", "s.runs.settled", "s.slice"))
    texts = common.stage(texts if unique else texts.dropDuplicates(_WHERE), "run-texts")
    blocks = common.stage(_parts(texts, length, BLOCK), "blocks")
    done, open_ = _split(_repeated(blocks, ["block", "r1", "r2"]), ["block", "r1", "r2"], "block")
    found = found.union(done)
    runs = texts.select(*_WHERE, F.col("d").alias("from"), "slice")
    start = F.col("t.from") - F.col("o.d")
    cut = open_.alias("o").join(runs.alias("t"), _equal_where("o", "t")).select(
        *[f"o.{c}" for c in _WHERE], "o.d", "o.n", "o.settled",
        F.substring(F.col("slice"), start + 1, F.col("o.n") + length - 1).alias("slice"))
    singles = common.stage(_parts(cut, length, 1), "singles")
    done = _repeated(singles, ["r1", "r2"]).where("not settled")
    return found.union(done.select("doc_id", "doc_hash", (F.col("a") - F.col("d")).alias("lo"), "n"))


def _equal_where(x: str, y: str) -> Column:
    out = F.lit(True)
    for c in _WHERE:
        out = out & F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}"))
    return out


def _parts(texts: DataFrame, length: int, block: int) -> DataFrame:
    """One row per block of the texts' starts, with its number, ranks and whole."""
    return (texts.select(*_WHERE, "settled", F.explode(_parts_udf(length, block)("slice", "d", "n")).alias("p"))
            .select(*_WHERE, "settled", "p.*").withColumn("block", F.floor(F.col("d") / block)))


def _same_row(i: str, h: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("doc_hash") == F.col(h))


def _listed(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with ``listed``: false where ``lists`` (keys ``i``, ``h``) certainly has no row for them."""
    return common.may_be_member(docs, common.member_filter(lists, ["i", "h"], "row-filter"),
                                [F.col("doc_id"), F.col("doc_hash")], "listed")


def _only_listed(docs: DataFrame, lists: DataFrame) -> DataFrame:
    return _listed(docs, lists).where("listed").drop("listed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    span: int = SPAN) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans``, ``kept_sha256``.

    ``spans`` are the removed [begin, end) byte ranges.
    """
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    ids = docs.select(F.col(id_col).alias("doc_id"))
    unique = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    # unique ids name the rows; otherwise the row hash is part of the name, and equal rows share their result
    mark = F.lit(0).cast("long") if unique else common.row_hash(F.col(id_col), F.col(text_col))
    key = [F.col(id_col).alias("doc_id"), mark.alias("doc_hash")]
    found = repeated_starts(docs, key, F.col(text_col), length, span, unique)
    lists = common.stage(found.groupBy(F.col("doc_id").alias("i"), F.col("doc_hash").alias("h"))
                         .agg(F.collect_set(F.struct("lo", "n")).alias("starts")), "removed")
    rows = _listed(docs.select(*key, F.col(text_col).alias("text")), lists)
    # texts that nothing is removed from stay where they are; only the others are joined with their lists
    whole = rows.where("not listed").select("doc_id", "text", F.lit(None).cast(lists.schema["starts"].dataType).alias("starts"))
    cut = rows.where("listed").join(lists, _same_row("i", "h"), "left").select("doc_id", "text", "starts")
    return whole.union(cut).select("doc_id", _kept_udf(length)("text", "starts").alias("k")).select("doc_id", "k.*")
