"""Best-scoring phrases of each language, grown best-first from prefix counts.

A text is lower-cased (A-Z), split into pieces and words; phrases of 2 to 4 words with
at least ``MIN_COUNT`` occurrences are candidates.  A phrase's score is the least
over its cuts of ``2 * SCALE * a / (l + r)``, rounded down, where a, l and r count the phrase, its
first part and its rest.

Bounds.  No phrase is more frequent than its parts, so a phrase that begins with p
scores at most ``min_k 2 * SCALE * f(p) / (f(p[:k]) + f(p))``, and one that ends with p the
same with p's last parts.  Pairs of words are counted whole.  A threshold T per
language then opens the frontier: only phrases whose bound as a beginning (or as an
end) reaches T are grown by a word.  Every phrase scoring T or more has all its
beginnings and ends in the frontier, and so are all the phrases that are one word
longer, which decide whether it is dropped.  If at least ``top`` phrases score T or more
and stay, the language is settled, ties included; else T falls and the frontier of the
unsettled languages is expanded.

Counting.  Each pass over the texts finds words with NumPy, adds up equal phrases of a
batch, and Spark adds up the batches.  A phrase is a row of 64-bit word hashes, seeded
by the language; if two words of the corpus share a hash the count starts again with
another seed, so counts are exact.  Tasks test whether a phrase may be grown in
bitmaps of a fixed size of hashed frontier phrases (built by Spark's bitmap
aggregate): a chance hit only counts a phrase in vain.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated
rows and null ids count like any rows; a language without candidates and an empty table
give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pieces

MIN_COUNT, TOP, SCALE = 30, 2000, 1_000_000
LONGEST = 4
#: Bits of a bitmap of words and of phrases; together at most 26 MB are broadcast.
WORD_BITS, PHRASE_BITS = 24, 26
#: The first threshold leaves about this many pairs of words per wanted phrase; each expansion four times as many.
FIRST_SHARE, WIDER = 3, 4
_CHUNK = 6 << 20
_GRADE = 10                     # thresholds are multiples of 2**_GRADE
_ROT = (0, 21, 42)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True


# Words of a batch -----------------------------------------------------------------------------
def words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of every word, distinct words by code, whether the next word is in the same piece)."""
    raw = b"\n".join(texts).translate(_LOWER)
    buf = np.frombuffer(raw, np.uint8)
    ends_piece = _BREAK[buf]
    inside = ~(ends_piece | _BLANK[buf])
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), [], np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    letters = buf[inside].tobytes()
    kind, width = (pa.binary(), np.int32) if len(letters) < 1 << 31 else (pa.large_binary(), np.int64)
    arr = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(letters)])
    coded = arr.dictionary_encode()
    breaks = np.concatenate([[0], np.cumsum(ends_piece)])
    same = np.append(breaks[start[1:]] == breaks[end[:-1]], False)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), same


def hashes(language: str, distinct: list[bytes], seed: int) -> np.ndarray:
    own = xxhash.xxh64_intdigest(language.encode(), seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in distinct), np.uint64, len(distinct))


def _by_language(batches):
    """(language, texts) of batches with columns lang, text."""
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for first, chunk in pieces.chunks(batch.column(1), _CHUNK):
            groups: dict[str, list[bytes]] = {}
            for k, text in enumerate(chunk):
                if text:
                    groups.setdefault(languages[first + k], []).append(text)
            yield from groups.items()


def _count_words(seed: int):
    def count(batches):
        for language, texts in _by_language(batches):
            codes, distinct, _ = words(texts)
            if distinct:
                yield pa.RecordBatch.from_arrays([
                    pa.array([language] * len(distinct)), pa.array(distinct, pa.binary()).cast(pa.string()),
                    pa.array(hashes(language, distinct, seed).view(np.int64)),
                    pa.array(np.bincount(codes, minlength=len(distinct)))], names=["lang", "word", "h", "n"])
    return count


def _bit(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _cells(h: np.ndarray, n: int) -> np.ndarray:
    """Cell of the n words from each position on; mirrors :func:`_cell`."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        x = h[k : k + m]
        out ^= (x << np.uint64(_ROT[k])) | (x >> np.uint64(64 - _ROT[k]))
    return out & np.uint64((1 << PHRASE_BITS) - 1)


def _count_phrases(seed: int, n: int, frequent, maps):
    """Phrases of n words that may be grown from the frontier, with their counts in a batch.

    ``frequent`` is the bitmap of frequent words; ``maps`` holds the bitmaps ``pairs`` of frequent
    pairs and, for phrases of n - 1 words, ``begin`` and ``end``.
    """
    names = [f"h{k}" for k in range(n)]

    def count(batches):
        common_words, m = frequent.value, maps.value if maps is not None else None
        for language, texts in _by_language(batches):
            codes, distinct, same = words(texts)
            size = len(codes) - n + 1
            if size <= 0:
                continue
            h = hashes(language, distinct, seed)
            known = _bit(common_words, h & np.uint64((1 << WORD_BITS) - 1))[codes]
            ok = known[:-1] & known[1:] & same[:-1]                 # a pair of frequent words
            row = h[codes]
            if m is not None:
                pair = np.flatnonzero(ok)
                ok[pair[~_bit(m["pairs"], _cells(row, 2)[pair])]] = False
            at = np.flatnonzero(np.logical_and.reduce([ok[k : k + size] for k in range(n - 1)]))
            if m is not None and len(at):
                cell = _cells(row, n - 1)
                at = at[_bit(m["begin"], cell[at]) | _bit(m["end"], cell[at + 1])]
            if not len(at):
                continue
            key = codes[at]
            for k in range(1, n):                                   # exact: pairs of small numbers
                if k > 1:
                    key = np.unique(key, return_inverse=True)[1]
                key = (key << 32) | codes[at + k]
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[at[first] + k].view(np.int64)) for k in range(n)] + [pa.array(times)], names=[*names, "n"])
    return count, ", ".join(f"{c} long" for c in [*names, "n"])


# Bitmaps --------------------------------------------------------------------------------------
def _cell(columns: list[str]) -> Column:
    out = F.col(columns[0])
    for k, c in enumerate(columns[1:], 1):
        out = out.bitwiseXOR(F.shiftleft(c, _ROT[k]).bitwiseOR(F.shiftrightunsigned(c, 64 - _ROT[k])))
    return out


def _bitmap(rows: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """Bits of the rows' cells: 2**bits bits, whatever the number of rows."""
    cell = _cell(columns).bitwiseAND((1 << bits) - 1) + 1          # Spark's buckets count from 1
    found = (rows.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("bit"))
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found:
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


# Scores ---------------------------------------------------------------------------------------
def _score(a: str, left: str, right: str) -> Column:
    """floor(2 * SCALE * a / (left + right)), in decimals."""
    wide = "cast({} as decimal(19, 0))".format
    return F.expr(f"{2 * SCALE} * {wide(a)} div ({wide(left)} + {wide(right)})")


def _names(n: int) -> list[str]:
    return [f"h{k}" for k in range(n)]


class _Corpus:
    """The texts, the counted words and the counted phrases of one run."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, min_count: int):
        self.texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                                 F.col(text_col).alias("text"))
        self.spark, self.min_count = docs.sparkSession, min_count
        for self.seed in range(1, 9):
            counted = self.texts.mapInArrow(_count_words(self.seed), "lang string, word string, h long, n long")
            self.words = common.stage(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("f")), "phrases-words")
            if self.words.groupBy("h").count().where("count > 1").isEmpty():
                break
        else:
            raise RuntimeError("words share a hash under every seed")
        self.frequent = common.stage(self.words.where(F.col("f") >= min_count), "phrases-frequent")
        self.known = self.spark.sparkContext.broadcast(_bitmap(self.frequent, ["h"], WORD_BITS))

    def word(self, k: int, with_language: bool = False) -> DataFrame:
        """Frequent words, hash as ``h<k>`` and count as ``f<k>``."""
        extra = ["lang"] if with_language else []
        return self.frequent.select(F.col("h").alias(f"h{k}"), F.col("f").alias(f"f{k}"), *extra)

    def count(self, n: int, languages: list[str] | None, maps: dict | None) -> DataFrame:
        """Counts ``a`` of phrases of n words with at least ``min_count``."""
        sent = self.spark.sparkContext.broadcast(maps) if maps is not None else None
        texts = self.texts if languages is None else self.texts.where(F.col("lang").isin(languages))
        count, schema = _count_phrases(self.seed, n, self.known, sent)
        return (texts.mapInArrow(count, schema).groupBy(*_names(n)).agg(F.sum("n").alias("a"))
                .where(F.col("a") >= self.min_count))


def _pairs(c: _Corpus) -> DataFrame:
    """Frequent pairs with language, score, cut counts, and bounds as a beginning and as an end."""
    counted = common.stage(c.count(2, None, None), "phrases-2")
    x = (counted.join(common.broadcast_if_small(c.word(0, True), 64), "h0")
         .join(common.broadcast_if_small(c.word(1), 64), "h1"))
    return common.stage(x.select(
        "lang", "h0", "h1", "a", F.col("f0").alias("l"), F.col("f1").alias("r"), _score("a", "f0", "f1").alias("score"),
        _score("a", "f0", "a").alias("begin"), _score("a", "f1", "a").alias("end")), "phrases-pairs")


def _longer(c: _Corpus, n: int, counted: DataFrame, shorter: list[DataFrame]) -> DataFrame:
    """Phrases of n words with the same columns; ``shorter`` holds the scored phrases of 2 to n - 1 words.

    A part that was not counted is outside the frontier, and the phrase's score
    stays null: it is below the threshold.
    """
    x = counted.join(common.broadcast_if_small(c.word(0, True), 64), "h0").withColumnRenamed("f0", "left1")
    last = c.word(n - 1).withColumnRenamed(f"f{n - 1}", "right1")
    x = x.join(common.broadcast_if_small(last, 64), f"h{n - 1}")
    for m, part in enumerate(shorter, 2):
        for side, first in (("left", 0), ("right", n - m)):
            keys = [F.col(f"h{k}").alias(f"h{first + k}") for k in range(m)]
            sub = part.select(*keys, F.col("a").alias(f"{side}{m}"))
            x = x.join(sub, [f"h{first + k}" for k in range(m)], "left")
    cuts = [F.struct(_score("a", f"left{k}", f"right{n - k}").alias("score"), F.lit(k).alias("k"),
                     F.col(f"left{k}").alias("l"), F.col(f"right{n - k}").alias("r")) for k in range(1, n)]
    known = F.lit(True)
    for k in range(1, n):
        known = known & F.col(f"left{k}").isNotNull() & F.col(f"right{n - k}").isNotNull()
    bound = {side: F.least(*[_score("a", f"{side}{k}", "a") for k in range(1, n)]) for side in ("left", "right")}
    part = {side: F.lit(True) for side in bound}
    for side in bound:
        for k in range(1, n):
            part[side] = part[side] & F.col(f"{side}{k}").isNotNull()
    x = x.withColumn("cut", F.when(known, F.array_min(F.array(*cuts))))
    return x.select("lang", *_names(n), "a", "cut.l", "cut.r", "cut.score",
                    F.when(part["left"], bound["left"]).alias("begin"), F.when(part["right"], bound["right"]).alias("end"))


def _staying(n: int, scored: DataFrame, longer: DataFrame | None, thresholds: DataFrame) -> DataFrame:
    """Phrases that reach their language's threshold and do not lie in a longer one of nearly their count."""
    x = scored.join(F.broadcast(thresholds), "lang").where(F.col("score") >= F.col("t"))
    if longer is not None:
        sides = [longer.select(*[F.col(f"h{k + at}").alias(f"h{k}") for k in range(n)], F.col("a").alias("around"))
                 for at in (0, 1)]
        around = sides[0].unionByName(sides[1]).groupBy(*_names(n)).agg(F.max("around").alias("around"))
        x = x.join(around, _names(n), "left").where(
            F.expr("around is null or 100 * cast(around as decimal(19, 0)) < 80 * cast(a as decimal(19, 0))"))
    missing = [F.lit(None).cast("long").alias(f"h{k}") for k in range(n, LONGEST)]
    return x.select("lang", *_names(n), *missing, "a", "l", "r", "score")


def _thresholds(grades: dict[str, dict[int, int]], want: int) -> dict[str, int]:
    """Per language the highest multiple of 2**_GRADE that ``want`` pairs of words reach; 0 if there are fewer."""
    out = {}
    for language, counts in grades.items():
        total, out[language] = 0, 0
        for g in sorted(counts, reverse=True):
            total += counts[g]
            if total >= want:
                out[language] = g << _GRADE
                break
    return out


def _grown(c: _Corpus, pairs: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Staying phrases of 2 to 4 words that reach their language's threshold."""
    spark, languages = c.spark, list(thresholds)
    t = spark.createDataFrame(list(thresholds.items()), "lang string, t long").coalesce(1)
    scored = [pairs.where(F.col("lang").isin(languages))]
    pair_map = _bitmap(scored[0], _names(2), PHRASE_BITS)
    for n in range(3, LONGEST + 1):
        frontier = scored[-1].join(F.broadcast(t), "lang")
        maps = {"pairs": pair_map} | {side: _bitmap(frontier.where(F.col(side) >= F.col("t")), _names(n - 1), PHRASE_BITS)
                                      for side in ("begin", "end")}
        counted = common.stage(c.count(n, languages, maps), f"phrases-{n}")
        scored.append(common.stage(_longer(c, n, counted, scored), f"phrases-scored-{n}"))
    found = None
    for n, x in enumerate(scored, 2):
        part = _staying(n, x, scored[n - 1] if n < LONGEST else None, t)
        found = part if found is None else found.unionByName(part)
    return common.stage(found, "phrases-staying")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases."""
    spark: SparkSession = docs.sparkSession
    common.prepare(spark)
    c = _Corpus(docs, lang_col, text_col, min_count)
    pairs = _pairs(c)
    grades: dict[str, dict[int, int]] = {}
    for r in (pairs.groupBy("lang", F.shiftright("score", _GRADE).alias("grade")).count()).collect():
        grades.setdefault(r["lang"], {})[r["grade"]] = r["count"]     # at most 977 grades a language
    settled, open_, want = [], set(grades), FIRST_SHARE * top
    while open_:
        thresholds = _thresholds({k: grades[k] for k in open_}, want)
        found = _grown(c, pairs, thresholds)
        stay = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        done = [k for k in open_ if thresholds[k] == 0 or stay.get(k, 0) >= top]
        settled.append(found.where(F.col("lang").isin(done)))
        open_ -= set(done)
        want *= WIDER
    return _ranked(c, settled, top)


def _ranked(c: _Corpus, settled: list[DataFrame], top: int) -> DataFrame:
    totals = c.words.groupBy("lang").agg(F.sum("f").alias("n"))       # one row a language
    if not settled:
        return totals.limit(0).select("lang", F.lit(0).cast("long").alias("rank"), F.lit("").alias("phrase"),
                                      *[F.col("n").alias(k) for k in ("a", "l", "r", "n", "score")])
    x = settled[0]
    for more in settled[1:]:
        x = x.unionByName(more)
    for k in range(LONGEST):
        spelt = c.frequent.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"))
        x = x.join(common.broadcast_if_small(spelt, 64), f"h{k}", "left")
    x = x.withColumn("phrase", F.concat_ws(" ", *[f"w{k}" for k in range(LONGEST)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    x = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return x.join(common.broadcast_if_small(totals, 64), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
