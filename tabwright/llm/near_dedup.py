"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A text's set is its distinct ``shingle``-word shingles (64-bit hashes of the
A-Z folded words).  Texts with equal sets form one class, represented by its
smallest id.  Per class, ``bands * rows`` MinHash samples give band keys, and
are folded into an odd sketch: each sample flips one bit of a bitmap, so the
population count of two bitmaps' XOR estimates how many samples differ.

1. In each band bucket every member is paired with the member of smallest id.
2. Pairs pass a size bound and the odd-sketch bound, then their full sets are
   compared.  Confirmed links give components.
3. Of the members of buckets that still hold several components, shingles in
   at most ``RARE`` such members are rare.  Members of different components that
   share a rare shingle among the first ones of both (fewest members first, as
   many as a link may leave unshared, plus one) are tested as pairs: at most
   ``RARE`` for each shingle.  Any other pair shares no rare shingle, if it
   links, so its intersection m is at most the smaller count of other shingles,
   and 100 * m >= percent * (na + nb - m) must hold.
4. In each such bucket the members of other components are paired with the one
   that has the smallest share of rare shingles (the least edited copy).
5. Buckets that still hold several components have their cross-component pairs
   tested inside a shuffled join, each pair in the first band it shares, which
   keeps only pairs within the bound of 3 and the sketch bound.  After this,
   every pair that met in a bucket is in one component or was rejected.

With 42 bands of 6 rows a pair at similarity 0.8 misses every bucket with
probability 3e-6; the sketch bound lies 5.5 standard deviations above the count
expected at 0.8.

Defined cases: texts without words (or null) have an empty set, link with
nothing and are their own component; with fewer words than a shingle the whole
sequence is the one shingle; repeated rows are one class; a null id counts as
larger than all others and a component of null ids has a null id; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE, BANDS, ROWS, BITS = 2, 42, 6, 1024
#: Members that a rare shingle has at most; any value gives the same result.
RARE = 32
_MULT = 0xD6E8FEB86659FD93
_NO_ID = (1 << 63) - 1
_SIGNATURE = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
])
_SET = T.StructType([T.StructField("k1", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(common.rolling(h, max(1, min(shingle, len(h))), _MULT))


def set_key(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):                 # blocks that stay in cache, whatever the text's length
        v = np.multiply.outer(a, s[i : i + 1024])
        v += b[:, None]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def _signature_udf(shingle: int, bands: int, rows: int, bits: int):
    rng = np.random.default_rng(7)
    k = bands * rows
    a = rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, k, np.uint64)
    salt = rng.integers(0, 1 << 63, k, np.uint64)

    @F.arrow_udf(_SIGNATURE)
    def signature(texts: pa.Array) -> pa.Array:
        out = {"n": [], "k": [], "bands": [], "sketch": []}
        for _, chunk in common.text_chunks(texts):
            for t in chunk:
                s = shingle_set(t, shingle)
                out["n"].append(len(s))
                if not len(s):
                    out["k"].append((None, None))
                    out["bands"].append(None)
                    out["sketch"].append(None)
                    continue
                low = minhashes(s, a, b)
                keyed = common.mix64(low ^ salt)
                band = np.zeros(bands, np.uint64)
                for column in keyed.reshape(bands, rows).T:
                    band = common.mix64(band * np.uint64(_MULT) + column)
                odd = np.bincount((keyed >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1
                out["k"].append(set_key(s).tolist())
                out["bands"].append(band.view(np.int64))
                out["sketch"].append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(out["n"], pa.int64()), pa.array([x[0] for x in out["k"]], pa.int64()),
             pa.array([x[1] for x in out["k"]], pa.int64()), pa.array(out["bands"], lists), pa.array(out["sketch"], lists)],
            ["n_shingles", "k1", "k2", "bands", "sketch"])

    return signature.asNondeterministic()


def _set_udf(shingle: int):
    @F.arrow_udf(_SET)
    def sets(texts: pa.Array) -> pa.Array:
        found = [shingle_set(t, shingle) for _, chunk in common.text_chunks(texts) for t in chunk]
        keys = [int(set_key(s)[0]) if len(s) else None for s in found]
        return pa.StructArray.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
            ["k1", "shingles"])

    return sets.asNondeterministic()


def sketch_bound(samples: int, bits: int, similarity: float, sigmas: float = 5.5) -> int:
    """XOR count that pairs at ``similarity`` stay below, but for ``sigmas`` standard deviations."""
    differ = samples * (1 - similarity)
    decay = math.exp(-4 * differ / bits)             # two flips for each differing sample
    mean = bits * (1 - decay) / 2
    var = samples * similarity * (1 - similarity) * (2 * decay) ** 2 + bits * (1 - decay * decay) / 4
    return math.ceil(mean + sigmas * math.sqrt(var))


def _xor_count(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def _near(na: Column, nb: Column, sa: Column, sb: Column, percent: int, bound: int) -> Column:
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (_xor_count(sa, sb) <= bound)


def _may_link(x: str, y: str, percent: int, bound: int) -> Column:
    n, m, rest = F.col(f"{x}.n"), F.col(f"{y}.n"), F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest"))
    return ((100 * rest >= percent * (n + m - rest))
            & _near(n, m, F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), percent, bound))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """One row per document row: ``doc_id``, ``doc_hash``, ``n_shingles``, ``component_id``."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH_BYTES)
    bound = sketch_bound(bands * rows, bits, percent / 100)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    sig = common.stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), ident.alias("id"),
        common.row_hash(F.col(id_col), F.col(text_col)).alias("doc_hash"),
        _signature_udf(shingle, bands, rows, bits)(F.col(text_col)).alias("s"))
        .select("doc_id", "id", "doc_hash", "s.*"), "signatures")

    reps = common.stage(
        sig.where("n_shingles > 0").groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"))
        .select(F.struct("id", "k1").alias("node"), "k1", "k2", "n", "bands", "sketch"), "classes")
    keyed = reps.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("size"), F.min("node.id").alias("centre")).where("size > 1")
    members = common.stage(keyed.join(shared.drop("size"), "band"), "members")

    centres = reps.select(F.col("node").alias("b"), F.col("node.id").alias("centre"), F.col("n").alias("nb"),
                          F.col("sketch").alias("sb"))
    ends = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    stars = (members.where("node.id != centre").select(F.col("node").alias("a"), "centre").distinct()
             .join(centres, "centre").join(ends, "a")
             .where(_near(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent, bound)).select("a", "b"))
    stars = common.stage(stars, "pairs")
    star_sets = _sets(docs, stars.select(F.col("a").alias("node")).union(stars.select("b")), ident, text_col, shingle)
    final = common.stage(components(_confirmed(star_sets, stars, percent)), "components")

    mixed = _mixed(members, final)
    sets = _sets(docs, mixed.select("node"), ident, text_col, shingle)
    rare = _rare_shingles(sets)
    own = rare.groupBy("node").agg(F.count("*").alias("own"))
    traits = common.stage(reps.join(own, "node", "left").join(sets.select("node"), "node", "left_semi")
                          .select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("rest"), "bands", "sketch"),
                          "traits")
    for candidates in (_hub_pairs, _rare_pairs, _cross_pairs):
        found = candidates(rare, mixed, traits, percent, bound) if candidates is _rare_pairs else \
            candidates(mixed, traits, percent, bound)
        linked = _confirmed(sets, common.stage(found, "pairs"), percent)
        final = common.stage(_merged(final, components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b")))),
                             "components")
        mixed = _mixed(members, final) if candidates is not _cross_pairs else mixed
    classes = reps.select("node", "k1", "k2").join(final, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("component"))
    out = sig.select("doc_id", "doc_hash", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    smallest = F.nullif(F.col("component.id"), F.lit(_NO_ID))
    top = out.where(F.col("doc_id") == _NO_ID)
    if not top.isEmpty():                             # the id that stands for a missing one is some row's own
        own = common.stage(top.select(F.col("component").alias("c"), F.lit(_NO_ID).alias("own")).distinct(), "top-id")
        out = out.join(common.broadcast_if_small(own, 48), F.col("component") == F.col("c"), "left")
        smallest = F.when(F.col("component.id") == _NO_ID, F.col("own")).otherwise(F.col("component.id"))
    return out.select("doc_id", "doc_hash", "n_shingles",
                      F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(smallest).alias("component_id"))


def _mixed(members: DataFrame, known: DataFrame) -> DataFrame:
    """``band, node, label`` of the buckets that hold several components."""
    label = members.join(known, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("label"))
    bands = label.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("band")
    return common.stage(label.join(bands, "band"), "mixed")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """``node, shingle, nodes``: the shingles of ``sets`` that at most ``RARE`` nodes have."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    few = each.groupBy("shingle").agg(F.count("*").alias("nodes")).where(F.col("nodes") <= RARE)
    return common.stage(each.join(few, "shingle"), "rare")


def _rare_pairs(rare: DataFrame, mixed: DataFrame, traits: DataFrame, percent: int, bound: int) -> DataFrame:
    """Pairs of different components (``a``, ``b``, labels ``la``, ``lb``) with a rare shingle among the first of both."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("nodes", "shingle"))
    about = mixed.select("node", "label").distinct().join(traits.select("node", "n", "sketch"), "node")
    first = (rare.withColumn("place", place).where("nodes > 1").join(about, "node")
             .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-6) + 1)
             .select("shingle", "node", "label", "n", "sketch"))
    first = common.stage(first, "first")
    x, y = first.alias("x"), first.alias("y")
    return (x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label"))
                   & _near(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent, bound))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                    F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct())


def _hub_pairs(mixed: DataFrame, traits: DataFrame, percent: int, bound: int) -> DataFrame:
    """Pairs (``a``, ``b``, labels ``la``, ``lb``) of a bucket's members with its member of fewest rare shingles."""
    own = traits.select("node", ((F.col("n") - F.col("rest")) / F.col("n")).alias("share"))
    hubs = (mixed.join(own, "node").groupBy("band").agg(F.min(F.struct("share", "node", "label")).alias("hub"))
            .select("band", F.col("hub.node").alias("b"), F.col("hub.label").alias("lb")))
    pairs = (mixed.join(hubs, "band").where("label != lb")
             .select(F.col("node").alias("a"), "b", F.col("label").alias("la"), "lb").distinct())
    x = traits.select(F.col("node").alias("a"), F.struct("n", "rest", "sketch").alias("x"))
    y = traits.select(F.col("node").alias("b"), F.struct("n", "rest", "sketch").alias("y"))
    return (pairs.join(x, "a").join(y, "b").where(_may_link("x", "y", percent, bound)).select("a", "b", "la", "lb"))


def _cross_pairs(mixed: DataFrame, traits: DataFrame, percent: int, bound: int) -> DataFrame:
    """All pairs of different components (``a``, ``b``, labels ``la``, ``lb``) that share a band and may link.

    A pair is made in the first band it shares alone: ``before`` holds the
    member's keys of the earlier bands.
    """
    before = F.slice("bands", F.lit(1), F.greatest(F.array_position("bands", F.col("band")) - 1, F.lit(0)).cast("int"))
    side = common.stage(mixed.join(traits, "node").select(
        "band", "node", "label", "n", "rest", "sketch", before.alias("before")), "sides")
    x, y = side.alias("x"), side.alias("y")
    return (x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") < F.col("y.label"))
                   & _may_link("x", "y", percent, bound) & ~F.arrays_overlap("x.before", "y.before"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                    F.col("x.label").alias("la"), F.col("y.label").alias("lb")))


def _merged(known: DataFrame, joined: DataFrame) -> DataFrame:
    """``known`` components (of nodes) with the links between them that ``joined`` (components of labels) found."""
    moved = (known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
             .select("node", F.coalesce("top", "component").alias("component")))
    lone = joined.join(known, joined["node"] == known["component"], "left_anti")
    return moved.union(lone.select("node", "component"))


def _sets(docs: DataFrame, nodes: DataFrame, ident: Column, text_col: str, shingle: int) -> DataFrame:
    """``node, shingles`` of the given nodes (column ``node``, repeats allowed)."""
    nodes = common.stage(nodes.distinct(), "nodes")
    ids = common.broadcast_if_small(nodes.select(F.col("node.id").alias("id")).distinct(), 16)
    sets = (docs.select(ident.alias("id"), F.col(text_col).alias("t")).join(ids, "id", "left_semi")
            .select("id", _set_udf(shingle)("t").alias("s"))
            .select(F.struct("id", "s.k1").alias("node"), "s.shingles"))
    return common.stage(sets.join(common.broadcast_if_small(nodes, 32), "node", "left_semi")
                        .groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``, ...) whose full sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    meet = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = F.size("sa").cast("long") + F.size("sb") - meet
    return common.stage(both.where(100 * meet >= percent * total).drop("sa", "sb"), "links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: the row of the smallest id (of repeated rows one)."""
    found = near_duplicates(docs, id_col, text_col)
    bad = common.stage(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                       .select(F.col("doc_id").alias("bad_id"), F.col("doc_hash").alias("bad_hash")).distinct(), "copies")
    kept = common.without(docs, id_col, text_col, bad)
    again = common.stage(found.groupBy(F.col("doc_id").alias("bad_id"), F.col("doc_hash").alias("bad_hash"))
                         .count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept
    # rows repeated with equal id and text: group-limited map-side, so one row of each leaves every partition
    rest = common.without(kept, id_col, text_col, again)
    tied = common.without(kept, id_col, text_col, again, "left_semi").select(F.struct("*").alias("row"))
    ident = F.col("row").getField(id_col)
    tied = tied.select("row", ident.alias("id"), common.row_hash(ident, F.col("row").getField(text_col)).alias("hash"))
    one = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return rest.unionByName(tied.withColumn("nth", one).where("nth = 1").select("row.*"))
