"""Alignment of the tokens of two tokenizers, and which pairs of ids the corpus links.

A is a byte-level BPE that encodes a space and the text, B a sentencepiece BPE that
puts the space there itself.  Both give byte ranges over the same bytes.  Where a
token of A and one of B end together lies a cut; the cuts divide both into groups, and
the two tokens that end at a cut are linked.

The merge runs in lockstep: a NumPy vector holds, for every lane, the next token of A
and of B.  Each step compares the two ends of all lanes at once, emits a link and a
cut where they are equal, moves A, B or both on, and drops finished lanes from the
vector.  A lane is a document or, in longer ones, a stretch of about ``LANE`` tokens
that begins at a cut, so that one long document does not step on alone.

How often each pair of ids is linked is added up within a batch and then over the
corpus.  The counts come back to the documents in two ways that together give each
pair its exact count: the most frequent pairs, at most ``head_pairs``, as a sorted
array in every worker, all others by a join on the pair.  So a pair that holds a third
of all links is never shuffled by its key.

Defined cases: null and empty texts and texts whose joined token bytes of A or B
differ from the space and the text have no tokens: zeros and an empty digest; rows with
equal or null ids are rows each for itself, and each counts in the corpus; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

LANE = 128
_CHUNK = 2 << 20
CACHE_PIECES = 150_000
HEAD_PAIRS = 500_000
_SPACE = b" "
_GROUPS = "array<struct<a:array<int>,b:array<int>>>"
_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


# Lockstep merge -------------------------------------------------------------------------------
def _lane_starts(end_a, end_b, first_a, last_a, first_b, last_b):
    """Starts of lanes: each document's first tokens, and cuts near every ``LANE``-th token of A."""
    at_a, at_b, doc = [first_a], [first_b], [np.arange(len(first_a))]
    n = (last_a - first_a - 1) // LANE
    n[n < 0] = 0
    if n.sum():
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        near = first_a[owner] + k * LANE
        open_ = np.arange(len(owner))
        for step in range(LANE // 2):                 # the first cut after it, if one is near
            a = near[open_] + step
            inside = a < last_a[owner[open_]] - 1
            open_, a = open_[inside], a[inside]
            if not len(open_):
                break
            b = np.searchsorted(end_b, end_a[a])
            cut = (b < last_b[owner[open_]]) & (end_b[np.minimum(b, len(end_b) - 1)] == end_a[a])
            at_a.append(a[cut] + 1)
            at_b.append(b[cut] + 1)
            doc.append(owner[open_[cut]])
            open_ = open_[~cut]
    i, j, doc = np.concatenate(at_a), np.concatenate(at_b), np.concatenate(doc)
    order = np.argsort(i, kind="stable")
    return i[order], j[order], doc[order]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray):
    """Pairs (i, j) of tokens that end together, in order.

    ``end_a`` and ``end_b`` are the byte ends of all documents' tokens in one row of
    bytes, ``bounds_*`` the n + 1 token bounds of the documents.
    """
    first_a, last_a, first_b, last_b = bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]
    some = (last_a > first_a) & (last_b > first_b)
    i, j, doc = _lane_starts(end_a, end_b, *(x[some] for x in (first_a, last_a, first_b, last_b)))
    last_a, last_b = last_a[some][doc], last_b[some][doc]
    if len(i):
        nxt = np.append(doc[1:] == doc[:-1], False)   # a lane ends where the document's next one begins
        stop = np.where(nxt, np.append(i[1:], 0), last_a)
        last_b = np.where(nxt, np.append(j[1:], 0), last_b)
    else:
        stop = last_a
    links_a, links_b = [], []
    state = np.stack([i, j, stop, last_b])
    state = state[:, (state[0] < state[2]) & (state[1] < state[3])]
    while state.shape[1]:
        i, j, stop_a, stop_b = state
        ea, eb = end_a[i], end_b[j]
        both = ea == eb
        links_a.append(i[both])
        links_b.append(j[both])
        i += ea <= eb
        j += eb <= ea
        live = (i < stop_a) & (j < stop_b)
        if not live.all():
            state = state[:, live]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a)                             # every token of A is in one link at most
    return a[order], b[order]


# Encoding -------------------------------------------------------------------------------------
class Aligner:
    """Both encoders of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = pieces.ByteBpe(path_a, plain_specials=True), pieces.PieceBpe(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        if not (self.size_a.all() and self.size_b.all()):
            raise ValueError("an id without bytes")
        self.known = pieces.Remembered(CACHE_PIECES)
        self.text_a, self.text_b = _digits(self.a.size), _digits(self.b.size)

    def _compute(self, words: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of A and of B of each piece, and whether the bytes of both are the piece's."""
        out = []
        for word, x, y in zip(words, self.a.encode(words), self.b.encode(words)):
            a = b"".join(map(self.bytes_a.__getitem__, np.frombuffer(x, self.a.dtype).tolist()))
            b = b"".join(map(self.bytes_b.__getitem__, np.frombuffer(y, self.b.dtype).tolist()))
            out.append((x, y, a == word and b == word))
        return out

    def batch(self, texts: list[bytes]):
        """(ids a, bounds a, ids b, bounds b, linked a positions, linked b positions) of space + text.

        Empty texts must be given as empty bytes; documents whose bytes differ come out without tokens.
        """
        p = pieces.Pieces([_SPACE + t if t else t for t in texts], self.a, self.b)
        values_a, values_b, exact = zip(*self.known.lookup(p.words, self._compute)) if p.words else ((), (), ())
        wrong = ~np.array(exact, bool)
        ids_a, at_a = p.ids(values_a, self.a.dtype)
        ids_b, at_b = p.ids(values_b, self.b.dtype)
        if wrong.any():
            ids_a, at_a, ids_b, at_b = self._without(p, wrong, ids_a, at_a, ids_b, at_b)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        return ids_a, at_a, ids_b, at_b, *lockstep(end_a, end_b, at_a, at_b)

    def _without(self, p, wrong, ids_a, at_a, ids_b, at_b):
        """Leaves out documents whose whole bytes differ."""
        marks = np.concatenate([[0], np.cumsum(wrong[p.codes])])
        doubtful = np.flatnonzero(np.diff(marks[p.first_piece]))
        out = []
        for ids, at, table in ((ids_a, at_a, self.bytes_a), (ids_b, at_b, self.bytes_b)):
            out.append([b"".join(map(table.__getitem__, ids[at[k] : at[k + 1]].tolist())) for k in doubtful])
        raw = p.buf.tobytes()
        keep = np.ones(len(at_a) - 1, bool)
        for k, x, y in zip(doubtful.tolist(), *out):
            text = raw[p.bounds[k] : p.bounds[k + 1]]
            keep[k] = x == text and y == text
        result = []
        for ids, at in ((ids_a, at_a), (ids_b, at_b)):
            n = np.diff(at)
            result += [ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n * keep)])]
        return result

    def digests(self, ids_a, at_a, ids_b, at_b, link_a, link_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        total = len(ids_a) + len(ids_b)
        if not total:
            return [b""] * (len(at_a) - 1)
        n_a, n_b = len(ids_a), len(ids_b)
        group_a, group_b = _groups_before(link_a, n_a), _groups_before(link_b, n_b)
        place_a = np.arange(n_a) + np.append(0, link_b + 1)[group_a]   # after the earlier groups' tokens of B
        place_b = np.arange(n_b) + (np.append(link_a, n_a - 1) + 1)[group_b]
        width = self.text_a[0].shape[1]
        chars, size = np.empty((total, width), np.uint8), np.empty(total, np.int64)
        for place, ids, (text, length), link, end in ((place_a, ids_a, self.text_a, link_a, b"|"),
                                                      (place_b, ids_b, self.text_b, link_b, b";")):
            chars[place], size[place] = text[ids], length[ids]
            chars[place[link], size[place[link]] - 1] = end[0]
        flat = chars[np.arange(width) < size[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[at_a + at_b].tolist()
        return [flat[lo : max(lo, hi - 1)] for lo, hi in zip(upto[:-1], upto[1:])]


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id below ``size`` with a comma, and how many characters they are."""
    shown = np.array([f"{i}," for i in range(size)], "S6")
    return shown.view(np.uint8).reshape(size, 6), np.char.str_len(shown)


def _groups_before(link: np.ndarray, n: int) -> np.ndarray:
    """For each of n tokens, the number of links of earlier tokens."""
    mark = np.zeros(n + 1, np.int64)
    mark[link + 1] = 1
    return np.cumsum(mark)[:n]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def groups(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """The input rows as ``row`` and their groups of ids as ``groups``; empty without tokens."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)

    @F.arrow_udf(_GROUPS)
    def grouped(texts: pa.Array) -> pa.Array:
        al, parts = aligner(path_a, path_b), []
        for _, chunk in pieces.chunks(texts, _CHUNK):
            ids_a, at_a, ids_b, at_b, link_a, link_b = al.batch(chunk)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, link + 1).astype(np.int32)), pa.array(ids.astype(np.int32)))
                     for ids, link in ((ids_a, link_a), (ids_b, link_b))]
            first = np.searchsorted(link_a, at_a).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(lists, ["a", "b"])))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct(
            [("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return docs.select(F.struct("*").alias("row"), grouped(F.col(text_col)).alias("groups"))


def _aligned_rows(path_a: str, path_b: str):
    def rows(batches):
        from pyspark import TaskContext
        al, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in _ROW.split(", ")]
        for batch in batches:
            docs = batch.column(0)
            for first, chunk in pieces.chunks(batch.column(1), _CHUNK):
                ids_a, at_a, ids_b, at_b, link_a, link_b = al.batch(chunk)
                keys = (ids_a[link_a].astype("<u4") << np.uint32(16)) | ids_b[link_b].astype("<u4")
                cut = np.searchsorted(link_a, at_a).tolist()
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in al.digests(ids_a, at_a, ids_b, at_b, link_a, link_b)]
                n = len(chunk)
                n_links = np.diff(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number, number + n)), docs.slice(first, n).cast(pa.int64()),
                    pa.array(np.diff(at_a)), pa.array(np.diff(at_b)), pa.array(n_links), pa.array(n_links),
                    pa.array(shas, pa.string()),
                    pa.array([keys[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())], names=names)
                number += n
    return rows


# Counts of linked pairs -----------------------------------------------------------------------
def _count_pairs(batches):
    """Pairs of a task with how often it links them, added up in turns."""
    keys, n = [], 0

    def flush():
        pair, count = np.unique(np.concatenate(keys), return_counts=True)
        keys.clear()
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(count.astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        column = batch.column(0)
        for k in range(len(column)):
            links = np.frombuffer(column[k].as_buffer() or b"", "<u4")
            keys.append(links)
            n += len(links)
            if n >= 1 << 22:
                yield flush()
                n = 0
    if n:
        yield flush()


def _with_counts(head):
    """Per document: sums over its links to head pairs, and the other pairs with how often they occur."""
    @F.arrow_udf("n_best long, count_sum long, rest array<struct<pair:long,m:long>>")
    def counted(links: pa.Array) -> pa.Array:
        key, count, best = head.value
        flat, sizes = [], []
        for k in range(len(links)):
            x = np.frombuffer(links[k].as_buffer() or b"", "<u4")
            flat.append(x)
            sizes.append(len(x))
        x = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        row = np.searchsorted(key, x)
        known = np.zeros(len(x), bool)
        if len(key):
            row = np.minimum(row, len(key) - 1)
            known = key[row] == x
        gained = np.where(known, count[row], 0) if len(key) else np.zeros(len(x), np.int64)
        topped = np.where(known, best[row], False) if len(key) else known
        sums = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (topped, gained)]
        sums = [s[at[1:]] - s[at[:-1]] for s in sums]
        doc = np.repeat(np.arange(len(sizes)), sizes)[~known]
        pair, m = np.unique((doc.astype(np.int64) << 32) | x[~known].astype(np.int64), return_counts=True)
        first = np.searchsorted(pair >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(
            [pa.array(pair & 0xFFFFFFFF), pa.array(m.astype(np.int64))], ["pair", "m"]))
        return pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), rest], ["n_best", "count_sum", "rest"])
    return counted


def _head(pairs: DataFrame, size: int):
    """The pairs above the lowest count that keeps them within ``size``, as arrays by pair: key, count, is best."""
    grade = F.floor(F.log2("n") * 8).cast("int")                 # at most 8 * 63 grades
    by_grade = {r.grade: r["count"] for r in pairs.groupBy(grade.alias("grade")).count().collect()}
    total, least = 0, None
    for g in sorted(by_grade, reverse=True):
        if total + by_grade[g] > size:
            break
        total, least = total + by_grade[g], g
    in_head = grade >= F.lit(least) if least is not None else F.lit(False)
    rows = pairs.where(in_head).select("pair", "n", "best").toArrow().sort_by("pair")      # at most ``size`` rows
    key, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    return (key.astype("<u4"), n.astype(np.int64), best.astype(bool)), in_head


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spark = docs.sparkSession
    common.prepare(spark, common.SMALL_BATCH_BYTES)
    if max(pieces.ByteBpe(path_a).size, pieces.PieceBpe(path_b).size) > 1 << 16:
        raise ValueError("a tokenizer with more than 65,536 ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = common.stage(rows.mapInArrow(_aligned_rows(path_a, path_b), _ROW), "align-rows")
    counted = aligned.select("links").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = common.stage(counted, "align-counts")
    best = counted.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("most"))   # at most 65,536 rows
    pairs = common.stage(
        counted.join(F.broadcast(best), F.col("pair").bitwiseAND(0xFFFF) == F.col("b"))
        .select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")
    head, in_head = _head(pairs, head_pairs)
    found = aligned.withColumn("c", _with_counts(spark.sparkContext.broadcast(head))(F.col("links"))).drop("links")
    found = common.stage(found, "align-head")
    rest = found.select("row", F.explode("c.rest").alias("r")).select("row", "r.pair", "r.m")
    rest = (rest.join(pairs.where(~in_head), "pair").groupBy("row")
            .agg(F.sum(F.col("m") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best")))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a.split(".")[-1])
    return found.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("c.n_best", "more_best"), plus("c.count_sum", "more_sum"),
        "groups_sha256")
