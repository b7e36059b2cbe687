"""Approximate nearest neighbours by inner product: NN-descent graph, greedy search.

Equal vectors form one class, represented by its smallest id; the graph is built
over classes.  Inner product becomes Euclidean distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm.

* The graph starts from a forest of random-projection trees: cut points are
  fitted on a bounded sample, every class is dealt to a leaf of every tree, large
  leaves are split by hash, and each part is compared in full.
* NN-descent then joins neighbours of neighbours: a node's list, forward and
  reverse, is joined with the vectors, and each pair in it is offered to both
  ends.  Long reverse lists are split by hash into several groups, each with the
  forward list; no neighbour is dropped.  Lists improve until few change.
* A query walks the graph from its own class and from entry nodes: the
  ``PER_CELL`` longest vectors of each of at most ``CELLS`` cells of directions (one
  more tree), of which the query takes the best ``BEAM`` by inner product.  Long
  vectors have large inner products with many queries, and the cells reach
  clusters that no edge of the graph joins.  The best unvisited nodes' lists are
  scored, ``HOPS`` times after the first.

Defined cases: null, zero, or non-finite vectors and vectors with null
components take no part; vectors of another length than most are compared over
the shorter length only by the exact score of their own kind (lengths are
grouped, each length is searched by itself); null ids take no part; repeated
rows (equal id and vector) count once; fewer candidates than asked give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NEIGHBOURS, TREES, LEAF, ROUNDS, HOPS, BEAM, K = 32, 8, 600, 3, 4, 80, 20
SAMPLE = 20000                 # vectors on which the trees' cut points are fitted
GROUP, CELLS, PER_CELL = 96, 256, 4
_LIST = T.ArrayType(T.StructType([T.StructField("d", T.FloatType()), T.StructField("id", T.LongType())]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def usable(vec: Column) -> Column:
    """Finite, non-null, non-zero vectors."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def product(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def fit_trees(sample: np.ndarray, leaves: int, trees: int, seed: int = 5) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per tree and level: directions and cut points (medians of the sample), one per node of the level."""
    rng, forest = np.random.default_rng(seed), []
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) // 8)))))
    for _ in range(trees):
        at, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            directions = rng.standard_normal((1 << level, sample.shape[1]))
            value = np.einsum("ij,ij->i", sample, directions[at])
            cuts = np.array([np.median(value[at == n]) if (at == n).any() else 0.0 for n in range(1 << level)])
            levels.append((directions, cuts))
            at = 2 * at + (value > cuts[at])
        forest.append(levels)
    return forest


def _leaves_udf(forest, dims: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def leaves(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors, dims)
        out = []
        for levels in forest:
            at = np.zeros(len(x), np.int64)
            for directions, cuts in levels:
                at = 2 * at + (np.einsum("ij,ij->i", x, directions[at]) > cuts[at])
            out.append(at)
        flat = np.stack(out, axis=1).ravel() if len(x) else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(forest), pa.int32()), pa.array(flat, pa.int32()))

    return leaves


def _lists_of(ids: np.ndarray, x: np.ndarray, keep: int, worst: np.ndarray | None = None):
    """For each row the ``keep`` nearest others: (id, distances, ids); only those below ``worst``."""
    sq = (x * x).sum(axis=1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    keep = min(keep, len(ids) - 1)
    near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < len(ids) - 1 else np.argsort(d, axis=1)[:, :keep]
    for i in range(len(ids)):
        at = near[i]
        dist = d[i, at]
        if worst is not None:
            at, dist = at[dist < worst[i]], dist[dist < worst[i]]
        at, dist = at[ids[at] != ids[i]], dist[ids[at] != ids[i]]
        if len(at):
            yield int(ids[i]), [{"d": float(v), "id": int(ids[j])} for v, j in zip(dist, at)]


def _offers_udf(dims: int, keep: int):
    """Member lists (id, worst, vector) of a group -> offers (id, list of nearer members)."""
    kind = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("near", _LIST)]))

    @F.arrow_udf(kind)
    def offers(members: pa.Array) -> pa.Array:
        out = []
        flat = members.flatten()
        ids, worst = flat.field("id").to_numpy(), flat.field("worst").to_numpy()
        x = flat.field("vec").flatten().to_numpy().reshape(-1, dims)
        at = members.offsets.to_numpy() - members.offsets[0].as_py()
        for b, e in zip(at[:-1], at[1:]):
            rows = _lists_of(ids[b:e], x[b:e], keep, worst[b:e]) if e - b > 1 else ()
            out.append([{"id": i, "near": n} for i, n in rows])
        near = pa.list_(pa.struct([("d", pa.float32()), ("id", pa.int64())]))
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("near", near)])))

    return offers.asNondeterministic()


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """(id, near) from several lists of each id: the ``keep`` nearest distinct ones."""
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return lists.groupBy("id").agg(F.slice(both, 1, keep).alias("near"))


def _grouped(rows: DataFrame, keys: list[str], dims: int, keep: int) -> DataFrame:
    member = F.struct("id", F.col("worst").cast("float").alias("worst"), "vec")
    groups = rows.groupBy(*keys).agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    return groups.select(F.explode(_offers_udf(dims, keep)("m")).alias("o")).select("o.id", "o.near")


def build_graph(nodes: DataFrame, dims: int, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """``id``, ``near`` (distance and id, nearest first) from ``nodes`` (id, vec: float array of ``dims``)."""
    n = nodes.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    some = nodes.where(place < 1_000_000 * min(1.0, SAMPLE / max(1, n))).select("vec").limit(2 * SAMPLE).toArrow()
    sample = _matrix(some["vec"].combine_chunks(), dims) if some.num_rows else np.zeros((0, dims), np.float32)
    forest = fit_trees(sample, n // LEAF, TREES if n > LEAF else 1)
    dealt = nodes.select("id", "vec", F.posexplode(_leaves_udf(forest, dims)("vec")).alias("tree", "leaf"))
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))   # at most trees * 2 ** depth rows
    dealt = dealt.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "tree"), F.col("parts"))).withColumn("worst", F.lit(float("inf")))
    graph = common.stage(_merged(_grouped(dealt, ["tree", "leaf", "part"], dims, neighbours), neighbours), "graph")
    for _ in range(rounds if n > LEAF else 0):
        edges = graph.select(F.col("id").alias("a"), F.explode("near.id").alias("b"))
        reverse = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        degree = reverse.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        forward = edges.union(graph.select("id", "id")).join(degree, "a", "left").select(
            "a", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("parts", F.lit(1).cast("long")))).alias("part"))
        back = reverse.join(degree, "a").select("a", "b", (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).alias("part"))
        lists = forward.union(back).distinct()
        worst = F.when(F.size("near") >= neighbours, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
        members = lists.join(nodes.join(graph.select("id", worst.alias("worst")), "id").select(
            F.col("id").alias("b"), "worst", "vec"), "b").select("a", "part", F.col("b").alias("id"), "worst", "vec")
        offers = _grouped(members, ["a", "part"], dims, 12)
        new = common.stage(_merged(offers.union(graph), neighbours), "graph")
        moved = new.join(graph.toDF("id", "old"), "id").agg(
            F.sum(F.size(F.array_except("near.id", "old.id"))) / F.sum(F.size("near"))).first()[0]
        graph = new
        if (moved or 0.0) < 0.002:
            break
    return graph


def entry_nodes(nodes: DataFrame, dims: int, cells: int = CELLS, per_cell: int = PER_CELL) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the longest nodes of each cell of directions: at most ``cells * per_cell`` rows."""
    size = F.sqrt(product(F.col("vec"), F.col("vec")))
    unit = nodes.select("id", "vec", size.alias("size")).withColumn("dir", F.transform(
        "vec", lambda x: (x / F.col("size")).cast("float")))
    n = nodes.count()
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000))
    some = unit.where(place < 1_000_000 * min(1.0, SAMPLE / max(1, n))).select("dir").limit(2 * SAMPLE).toArrow()
    sample = _matrix(some["dir"].combine_chunks(), dims) if some.num_rows else np.zeros((0, dims), np.float32)
    forest = fit_trees(sample, cells, 1, seed=11)
    longest = Window.partitionBy("cell").orderBy(F.desc("size"), "id")
    best = (unit.withColumn("cell", F.element_at(_leaves_udf(forest, dims)("dir"), 1)).drop("dir")
            .withColumn("nth", F.row_number().over(longest)).where(F.col("nth") <= per_cell).select("id", "vec").toArrow())
    vectors = best["vec"].combine_chunks()
    x = _matrix(vectors.cast(pa.list_(pa.float64())), dims) if best.num_rows else np.zeros((0, dims))
    return best["id"].to_numpy(), x


def _entries_udf(ids: np.ndarray, x: np.ndarray, dims: int, keep: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def entries(vectors: pa.Array) -> pa.Array:
        q = _matrix(vectors.cast(pa.list_(pa.float64())), dims)
        k = min(keep, len(ids))
        best = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * k, pa.int32()), pa.array(ids[best].ravel()))
    return entries


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dims: int, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """``q``, ``id``: the best ``beam`` nodes found for each query (node ids), its own among them."""
    vec = nodes.select(F.col("id").alias("b"), F.col("vec").alias("bv"))
    own = nodes.join(queries, "id").select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    links = graph.select(F.col("id").alias("a"), F.col("near.id").alias("to"))
    ids, x = entry_nodes(nodes, dims)
    start = own.select("q", F.explode(_entries_udf(ids, x, dims, beam)("qv")).alias("b")) if len(ids) else None
    found = common.stage(own.select("q", F.col("q").alias("id"), F.lit(None).cast("double").alias("score"),
                                    F.lit(False).alias("done")), "beam")
    best = Window.partitionBy("q").orderBy(F.col("score").desc_nulls_first(), "id")
    for hop in range(hops + 1):
        open_ = found.where("not done").select("q", F.col("id").alias("a"))
        if open_.isEmpty():
            break
        new = open_.join(links, "a").select("q", F.explode("to").alias("b"))
        new = new.union(start) if hop == 0 and start is not None else new
        new = (new.distinct().join(found.select("q", F.col("id").alias("b")), ["q", "b"], "left_anti"))
        scored = new.join(vec, "b").join(own, "q").select(
            "q", F.col("b").alias("id"), product(F.col("qv"), F.col("bv")).alias("score"), F.lit(False).alias("done"))
        whole = found.withColumn("done", F.lit(True)).union(scored)
        found = common.stage(whole.withColumn("n", F.row_number().over(best)).where(F.col("n") <= beam).drop("n"), "beam")
    return found.select("q", "id")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = common.stage(
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
        .select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("raw")).distinct(), "vectors")
    lengths = [r.n for r in rows.select(F.size("raw").alias("n")).distinct().orderBy("n").collect()]  # kinds of vectors
    out = None
    for dims in lengths:
        part = _nearest(rows.where(F.size("raw") == dims), dims, every, k)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _nearest(rows: DataFrame, dims: int, every: int, k: int) -> DataFrame:
    top = rows.agg(F.max(product(F.col("raw"), F.col("raw")))).first()[0]
    # k + 1 smallest ids of each class are all that any answer can name
    in_class = Window.partitionBy("raw").orderBy("vid")
    classes = common.stage(rows.groupBy("raw").agg(F.min("vid").alias("id")), "classes")
    named = common.stage(rows.withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= k + 1)
                         .join(classes, "raw").select("id", "vid"), "named")
    last = F.sqrt(F.greatest(F.lit(0.0), F.lit(top) - product(F.col("raw"), F.col("raw"))))
    lifted = F.transform(F.concat(F.transform("raw", lambda x: x.cast("double")), F.array(last)), lambda x: x.cast("float"))
    nodes = common.stage(classes.select("id", lifted.alias("vec")), "nodes")
    plain = classes.select("id", F.col("raw").alias("vec"))
    graph = build_graph(nodes, dims + 1)
    asked = rows.where(F.pmod("vid", F.lit(every)) == 0).join(classes, "raw").select("vid", "id")
    asked = common.stage(asked, "queries")
    near = search(graph, plain, asked.select("id").distinct(), dims)
    # scored once per class pair; the classes' ids are named, the k + 1 best kept, then each query drops itself
    both = near.join(plain.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q").join(plain, "id")
    scored = both.select("q", "id", product(F.col("qv"), F.col("vec")).alias("score")).join(named, "id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "vid", "score")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("vid").alias("query_id"), F.col("id").alias("q")).join(best, "q")
            .where("query_id != vid").select("query_id", F.col("vid").alias("vec_id"), "score")
            .withColumn("rank", F.row_number().over(mine).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
