"""Toxicity: boosted trees over dense lexical features, with isotonic calibration.

The lexicon is learnt: words and word beginnings (3 to 6 letters) that occur in
toxic texts far more often than in clean ones, with their log odds as weights.
Labelled rows are halved by a hash of the id, and each half's features come from
the other half's lexicon, so that the trees see the lexicon as it does on new
texts; scoring uses the lexicon of all labelled rows.  Gradient-boosted trees
learn from four fifths of the rows: lexicon densities, nearness of second-person
words to lexicon hits, capitals, exclamation and question marks, and obfuscated
spellings.  The last fifth fits the isotonic calibration.  Scoring reads texts
alone.

Learning uses at most ``MAX_LABELLED`` labelled rows, chosen by id hash (a bound
for fitting only); every document is scored over its whole text.

Defined cases: null and empty texts have all-zero features and are scored like
any other; null ids and labels are not learnt from; repeated label rows count
once; without rows of both labels the score of every text is the rate of toxic
rows (0 without labels); other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 20000
MAX_TERMS = 4000
THRESHOLD = 0.3
MIN_TOXIC, MIN_WEIGHT, STRONG = 3, 1.5, 3.0
_PREFIXES = (3, 4, 5, 6)
# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te ti toi ton ta tes "
                          "vous votre vos tú tus usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[\w@$]+")
_OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$", "oieastas")
_SPAN = 5
N_FEATURES = 13


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: object = None
    calibration: object = None
    rate: float = 0.0


def terms(word: str) -> list[str]:
    return [word] + [word[:k] + "*" for k in _PREFIXES if len(word) > k]


class _Weights(dict):
    """Word -> lexicon weight (0: none), filled as words turn up; emptied when it grows large."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        plain = word.translate(_LEET)
        w = max(self.lexicon.get(t, 0.0) for x in {word, plain} for t in terms(x))
        self[word] = w
        return w


def features(text: str | None, weights: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    hit = np.flatnonzero(w)
    strong = int((w >= STRONG).sum())
    you = np.array([i for i, x in enumerate(words) if x in SECOND_PERSON], np.int64)
    near = 0.0
    if len(hit) and len(you):
        right = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hit), np.abs(you[np.maximum(right - 1, 0)] - hit))
        near = float((gap <= _SPAN).mean())
    upper = sum(map(str.isupper, text))
    letters = max(1, sum(map(str.isalpha, text)))
    return [math.log1p(len(words)), len(hit) / n, strong / n, float(w.sum()) / n, float(w.max(initial=0.0)),
            math.log1p(strong), len(set(words[i] for i in hit)) / n, len(you) / n, near, upper / letters,
            (text.count("!") + text.count("?")) / len(text), len(_OBFUSCATED.findall(text)) / n,
            len(_STRETCHED.findall(text)) / n]


def _features_udf(lexicon: dict[str, float]):
    weights = _Weights(lexicon)              # a task's own, kept over its batches

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py(), weights) for t in texts], pa.list_(pa.float64()))

    return vectors


def _term_counts(batches):
    """(term, toxic rows, rows) of each half, summed within a batch."""
    for batch in batches:
        tally = {}
        for t, y, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = {x for w in set(_WORD.findall((t or "").lower())) for x in terms(w)}
            tally.setdefault((half, True), Counter()).update(own)
            if y:
                tally.setdefault((half, False), Counter()).update(own)
        for half in {h for h, _ in tally}:
            every, toxic = tally[half, True], tally.get((half, False), {})
            yield pa.RecordBatch.from_arrays(
                [pa.array([half] * len(every), pa.int32()), pa.array(list(every), pa.string()),
                 pa.array([toxic.get(x, 0) for x in every], pa.int64()), pa.array(list(every.values()), pa.int64())],
                names=["half", "term", "toxic", "rows"])


def learn_lexicons(rows: DataFrame) -> dict[int | None, dict[str, float]]:
    """Term weights from each half of ``rows`` (text, label, half) and, under None, from both.

    Each has at most ``MAX_TERMS`` terms, the best supported ones.
    """
    counts = common.stage(
        rows.select("text", "label", "half").mapInArrow(_term_counts, "half int, term string, toxic long, rows long")
        .groupBy("half", "term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")), "terms")
    found = {}
    for half in (0, 1, None):
        part = F.lit(True) if half is None else F.col("half") == half
        bad, n = rows.where(part).agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
        weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("rows") - F.col("toxic") + 0.5) / (n - bad + 1))
        best = (counts.where(part).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
                .where(F.col("toxic") >= MIN_TOXIC).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
                .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(MAX_TERMS))
        found[half] = {r.term: r.weight for r in best.collect()}
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``labels`` (``id_col``, ``label_col``); the caller leaves out held-out rows."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("label")))
    n = known.count()
    place = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1_000_000))
    some = known.where(place < 1_000_000 * min(1.0, max_labelled / max(n, 1)))     # about max_labelled rows: broadcast
    rows = common.stage(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
                        .join(F.broadcast(some), "__id")
                        .withColumn("half", F.pmod(F.xxhash64("__id", F.lit(12)), F.lit(2)).cast("int"))
                        .withColumn("part", F.pmod(F.xxhash64("__id", F.lit(13)), F.lit(5))), "labelled")
    lexicons = learn_lexicons(rows)
    model = Model(lexicon=lexicons[None])
    crossed = [rows.where(F.col("half") == h).select("part", "label", _features_udf(lexicons[1 - h])("text").alias("f"))
               for h in (0, 1)]
    data = common.stage(crossed[0].union(crossed[1]), "features")
    vec = data.withColumn("features", array_to_vector("f")).drop("f")
    boost, calibrate = vec.where("part < 4"), vec.where("part = 4")
    kinds = {r.label: r["count"] for r in boost.groupBy("label").count().collect()}   # two rows
    model.rate = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
    if len(kinds) == 2:
        model.trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2,
                                    minInstancesPerNode=10, seed=3).fit(boost)
        scored = _raw(model.trees, calibrate)
        if not scored.isEmpty():
            model.calibration = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="score").fit(scored)
    return model


def _raw(trees, df: DataFrame) -> DataFrame:
    out = trees.transform(df)
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) and ``score`` in [0, 1], higher: likelier toxic."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    if model.trees is None:
        return rows.select("row", F.lit(float(model.rate)).alias("score"))
    rows = rows.select("row", array_to_vector(_features_udf(model.lexicon)("text")).alias("features"))
    rows = _raw(model.trees, rows)
    if model.calibration is not None:
        rows = model.calibration.transform(rows)
    else:
        rows = rows.withColumn("score", F.col("raw"))
    return rows.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_default(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, input columns only."""
    return score(docs, train_default(docs, labels)).where(F.col("score") < threshold).select("row.*")
