"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or abstain (0) on every
text.  Their accuracies are not known: expectation-maximisation over the counts
of vote patterns (at most 3 ** labellers of them, counted over all documents)
estimates, for each labeller, how it votes on good texts and on each kind of bad
ones, and their shares.  The posterior of a text's pattern is its weak label, and a
hashed linear scorer (logistic loss over hashed words, word shapes and repeat
marks) learns from these labels, so that it also judges texts on which the
labellers abstain.

The scorer fits on about ``MAX_FIT`` documents chosen by the hash of their text, equal
ones as one row with a weight (a bound for fitting only); votes are counted over all
documents, and every text is scored whole.

Defined cases: null and empty texts get the labellers' votes for no words and
score by the scorer's offset; with an empty table there are no rows; if only one
kind of text turns up the scores stay at its share; repeated rows score alike;
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMS, MAX_FIT, ROUNDS, RATE, RIDGE = 1 << 14, 20000, 40, 0.2, 1e-4
KEEP = 0.5
_PLAIN = "0123456789.,;:!?'\"()-"
_END = tuple(".!?:;\"')")

LABELLERS = ("length", "repeats", "case", "symbols", "sentences", "lines", "marks")


def votes(text: str | None) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 abstains."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] + [0] * (len(LABELLERS) - 1)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    distinct = len(set(words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    marks = sum(text.count(c) for c in "!?") / n
    odd = 1 - (letters + sum(map(text.count, _PLAIN)) + sum(map(str.isspace, text))) / len(text)
    mean = sum(map(len, words)) / n

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else int(good)

    return [vote(n < 4 or mean > 20 or mean < 2, n >= 20 and 3 <= mean <= 12),
            vote(same > 0.2 or (n >= 50 and distinct < 0.15), same < 0.02),
            vote(upper > 0.5 * max(1, letters), upper < 0.15 * max(1, letters)),
            vote(odd > 0.05, odd < 0.02),
            vote(n >= 20 and not any(w.endswith(_END) for w in words), n / max(1, sum(w.endswith(".") for w in words)) < 40),
            vote(len(lines) >= 4 and again > 0.3, len(lines) >= 2 and again == 0),
            vote(marks > 0.3, marks < 0.05)]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def votes_column(texts: pa.Array) -> pa.Array:
    return pa.array([votes(t.as_py()) for t in texts], pa.list_(pa.int32()))


@dataclass
class LabelModel:
    """A mixture of good texts and, for every labeller, the texts with its kind of fault."""
    prior: np.ndarray             # [1 + labellers]: share of good texts, then of each kind of bad ones
    table: np.ndarray             # [1 + labellers, labeller, vote + 1]: how it votes on the texts of a class

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        onehot = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)
        score = np.log(self.prior) + np.einsum("pkv,ckv->pc", onehot, np.log(self.table))
        share = np.exp(score - score.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely a text with these votes is good."""
        return self.classes(patterns)[:, 0]

    @property
    def good(self) -> np.ndarray:
        """How the labellers vote on good texts."""
        return self.table[0]

    @property
    def bad(self) -> np.ndarray:
        """How they vote on bad texts of any kind."""
        return np.einsum("c,ckv->kv", self.prior[1:], self.table[1:]) / self.prior[1:].sum()


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM for good texts and one kind of bad ones per labeller, votes independent within a class.

    Labellers look for different faults, so bad texts have little in common and one
    class for all of them would settle on the commonest fault.  Begun with a bad vote
    meaning a bad text of the kinds of those who cast it.
    """
    k = patterns.shape[1]
    faults = patterns < 0
    any_ = faults.any(axis=1)
    post = np.empty((len(patterns), k + 1))
    post[:, 0] = np.where(any_, 0.05, 0.95)
    post[:, 1:] = np.where(any_[:, None], faults * (0.95 / np.maximum(1, faults.sum(axis=1)))[:, None], 0.05 / k)
    onehot = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)
    for _ in range(rounds):
        weight = counts[:, None] * post
        total = weight.sum(axis=0)
        model = LabelModel((total + 1) / (total.sum() + k + 1),
                           (np.einsum("pc,pkv->ckv", weight, onehot) + 0.1) / (total[:, None, None] + 0.3))
        new = model.classes(patterns)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return model


def _shape(word: str) -> str:
    out = []
    for c in word:
        s = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:6])


class _Buckets(dict):
    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        own = (xxhash.xxh3_64_intdigest(word.lower()) % self.dims, xxhash.xxh3_64_intdigest("~" + _shape(word)) % self.dims)
        self[word] = own
        return own


def hashed(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, of unit length."""
    words = (text or "").split()
    pairs = np.array([buckets[w] for w in words], np.int64).reshape(-1, 2)
    same = sum(a == b for a, b in zip(words, words[1:]))
    count = np.bincount(pairs.ravel()) if len(pairs) else np.zeros(0)
    at = np.flatnonzero(count)
    value = np.sqrt(count[at])
    at = np.append(at, [buckets.dims, buckets.dims + 1])                       # offset, repeat mark
    value = np.append(value / max(1e-9, np.linalg.norm(value)), [1.0, 4 * same / max(1, len(words))])
    return at, value


def _gradient(weights: np.ndarray, dims: int):
    """Summed logistic-loss gradient of the rows (idx, val, p, w): one row for each task."""
    def partial(batches):
        grad, n = np.zeros(dims + 2), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, val = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            sizes = np.diff(batch.column(0).offsets.to_numpy())               # every row has the offset bucket
            z = np.add.reduceat(weights[idx] * val, np.cumsum(sizes) - sizes)
            w = batch.column(3).to_numpy()
            error = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - batch.column(2).to_numpy())
            grad += np.bincount(idx, weights=val * np.repeat(error, sizes), minlength=dims + 2)
            n += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary()), pa.array([n], pa.float64())], names=["g", "n"])
    return partial


def _fit_udf(dims: int):
    """Votes and hashed features of texts, from one Python worker."""
    kind = T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("idx", T.ArrayType(T.IntegerType())),
                         T.StructField("val", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(kind)
    def vectors(texts: pa.Array) -> pa.Array:
        buckets, cast, at, value = _Buckets(dims), [], [], []
        for t in texts:
            text = t.as_py()
            cast.append(votes(text))
            a, v = hashed(text, buckets)
            at.append(a.astype(np.int32))
            value.append(v)
        return pa.StructArray.from_arrays([pa.array(cast, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32())),
                                           pa.array(value, pa.list_(pa.float64()))], ["votes", "idx", "val"])
    return vectors.asNondeterministic()


@dataclass
class Model:
    labels: LabelModel | None
    weights: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", max_fit: int = MAX_FIT, dims: int = DIMS) -> Model:
    spark = docs.sparkSession
    common.prepare(spark, common.SMALL_BATCH_BYTES)
    texts = docs.select(F.col(text_col).alias("text"))
    seen = texts.select(votes_column("text").alias("votes")).groupBy("votes").count().collect()   # at most 3 ** 7 patterns
    if not seen:
        return Model(None, np.zeros(dims + 2))
    patterns, counts = np.array([r.votes for r in seen]), np.array([r["count"] for r in seen], float)
    labels = fit_labels(patterns, counts)
    post = labels.posterior(patterns)
    table = spark.createDataFrame([(list(map(int, p)), float(q)) for p, q in zip(patterns, post)],
                                  "votes array<int>, p double")
    place = F.xxhash64("text", F.lit(5))
    share = min(1.0, max_fit / counts.sum())
    some = texts.select("text", place.alias("place")).where(F.pmod("place", F.lit(1 << 40)) < int((1 << 40) * share))
    once = common.stage(some.groupBy("place").agg(F.first("text").alias("text"), F.count("*").cast("double").alias("w"))
                        .drop("place"), "fit-texts")
    fit = common.stage(once.select(_fit_udf(dims)("text").alias("h"), "w").select("h.*", "w").join(F.broadcast(table), "votes")
                       .select("idx", "val", "p", "w"), "weak-labels")
    weights, size = np.zeros(dims + 2), np.full(dims + 2, 1e-8)
    for _ in range(ROUNDS):                                                    # Adagrad on the whole sample
        parts = fit.mapInArrow(_gradient(weights, dims), "g binary, n double").collect()   # one bounded row per task
        n = sum(r.n for r in parts)
        if not n:
            break
        grad = sum(np.frombuffer(bytes(r.g)) for r in parts) / n + RIDGE * weights
        size += grad * grad
        weights = weights - RATE * grad / np.sqrt(size)
    return Model(labels, weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """``row`` (the input row as a struct) and ``score`` in (0, 1): likelier good when higher."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    weights = model.weights

    @F.arrow_udf(T.DoubleType())
    def judge(texts: pa.Array) -> pa.Array:
        buckets = _Buckets(dims)
        out = []
        for t in texts:
            at, value = hashed(t.as_py(), buckets)
            out.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ value, -30, 30)))))
        return pa.array(out, pa.float64())

    return docs.select(F.struct("*").alias("row"), judge(F.col(text_col)).alias("score"))
