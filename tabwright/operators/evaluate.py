"""Evaluation jobs.

Statement scoring (E4/E5) never pairs predicted with gold statements.  Each
statement is scored against the *set* of statements on the other side of
its id: the exact scorer asks whether an equal statement exists there, the
lexical scorer what share of the statement's tokens occur there.  Both are
semi joins on ``(id, statement)`` or ``(id, token)``, linear in the input,
so an id holding a third of all statements costs a third of the work, not
the square of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .overlap import best_overlap
from . import extract

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# E1 / E2 -------------------------------------------------------------------------------
def _type_ok(t: Column, v: Column) -> Column:
    return (F.when(t == "integer", T.is_int_text(v))
            .when(t == "number", T.is_float_text(v) | T.is_int_text(v))
            .when(t == "date", T.is_date_text(v))
            .when(t == "boolean", T.is_bool_text(v))
            .otherwise(F.lit(True)))


def sanity_flags(gens: DataFrame, key: str, messages_col: str = "messages",
                 gen_col: str = "generation_only", fallback_col: str | None = "generation") -> DataFrame:
    """Per-sample structural checks of NDJSON generations against the prompt schema.

    Returns ``(key, json_ok, keys_ok, types_ok)`` for samples with a non-empty
    generation.  Key order is checked only when every line parses; a line
    that is not an object counts as a key mismatch; types are checked on the
    rows before the first mismatching row.  All in one narrow stage.
    """
    g = F.coalesce(F.when(F.col(gen_col) != "", F.col(gen_col)), F.lit(""))
    if fallback_col:
        g = F.when(g != "", g).otherwise(F.coalesce(F.col(fallback_col), F.lit("")))
    schema = extract.schema_from_user_turn(extract.first_user_turn(messages_col))
    df = gens.select(key, g.alias("_g"), schema["fields"].alias("_f")).filter(F.col("_g") != "")
    names = F.transform(F.coalesce(F.col("_f"), F.array()), lambda f: F.coalesce(f["name"], F.lit("")))
    # rows whose types are checked have the schema's names as keys, in order (so no name twice): types go by place
    types = F.transform(F.coalesce(F.col("_f"), F.array()), lambda f: F.coalesce(f["type"], F.lit("string")))
    df = df.select(key, names.alias("_names"), types.alias("_types"), extract.ndjson_rows(F.col("_g")).alias("_v"))

    def line_types_ok(x, types):
        checks = F.zip_with(x["values"], types, lambda v, t: v.isNull() | (v == "") | _type_ok(t, v))
        return F.coalesce(F.forall(checks, lambda b: b), F.lit(True))

    def verdict(rows, names, types):
        key_ok = F.transform(rows, lambda x: x["is_object"] & F.coalesce(x["keys"] == names, F.lit(False)))
        first = F.array_min(F.transform(key_ok, lambda ok, i: F.when(~ok, i).otherwise(F.lit(1 << 30))))
        return T.let(first, lambda bad: F.struct(
            F.forall(rows, lambda x: x["ok"]).alias("json"), F.coalesce(bad >= F.lit(1 << 30), F.lit(True)).alias("keys"),
            F.forall(F.transform(rows, lambda x, i: (i >= bad) | line_types_ok(x, types)), lambda b: b).alias("types")))
    df = df.select(key, T.let(F.col("_v"), lambda rows: T.let(F.col("_names"), lambda names: T.let(
        F.col("_types"), lambda types: verdict(rows, names, types)))).alias("_ok"))
    return df.select(key, F.col("_ok.json").alias("json_ok"), (F.col("_ok.json") & F.col("_ok.keys")).alias("keys_ok"),
                     (F.col("_ok.json") & F.col("_ok.types")).alias("types_ok"))


def sanity_report(flags: DataFrame) -> DataFrame:
    """One row of rates over the non-empty generations."""
    n = F.count(F.lit(1))
    return flags.agg(
        n.cast("bigint").alias("samples"),
        (F.count(F.when(F.col("json_ok"), 1)) / F.greatest(n, F.lit(1))).alias("json_valid_rate"),
        (F.count(F.when(F.col("keys_ok"), 1)) / F.greatest(n, F.lit(1))).alias("key_order_pass_rate"),
        (F.count(F.when(F.col("types_ok"), 1)) / F.greatest(n, F.lit(1))).alias("type_check_pass_rate"))


def sanity_failures(flags: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The whole ledger ``(sample, reason)`` in sample order; with ``limit`` its first rows (e.g. ``K.MAX_FAILURES``)."""
    reasons = F.array(
        F.when(~F.col("json_ok"), F.struct(F.lit(0).alias("r"), F.lit("json_parse_error").alias("reason"))),
        F.when(F.col("json_ok") & ~F.col("keys_ok"), F.struct(F.lit(1).alias("r"), F.lit("key_order_mismatch").alias("reason"))),
        F.when(F.col("json_ok") & ~F.col("types_ok"), F.struct(F.lit(2).alias("r"), F.lit("type_mismatch").alias("reason"))))
    x = flags.select(F.col(key).alias("sample"), F.explode(reasons).alias("f")).filter(F.col("f").isNotNull())
    # dealt by sample first: a range sort reads its input twice (once to choose the ranges), and so reads
    # the shuffled failures, not the generations
    x = x.repartition("sample").orderBy("sample", "f.r")
    return (x if limit is None else x.limit(limit)).select("sample", F.col("f.reason").alias("reason"))


# E3 ---------------------------------------------------------------------------------------
def aligned_ids(gold_ids: DataFrame, pred_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Gold ids that appear in any predicted category (a semi join).

    Both sides are de-duplicated first, so a hot id is collapsed map-side
    before the shuffle instead of arriving once per predicted file.
    """
    return gold_ids.select(id_col).distinct().join(pred_ids.select(id_col).distinct(), id_col, "left_semi")


# E4 / E5 ----------------------------------------------------------------------------------
def tokens(x) -> Column:
    """Distinct lower-case word tokens (letters/digits)."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(x)), TOKEN_SPLIT, -1), lambda t: t != ""))


def best_scores(pred: DataFrame, gold: DataFrame, scorer: str = "token_overlap") -> tuple[DataFrame, DataFrame]:
    """A score in [0, 1] for every predicted and every gold statement.

    ``pred``: ``(category, id, pos, statement)``; ``gold``: ``(id, pos, statement)``.
    The hypothesis is the statement being scored, the premise one single statement
    of the other side with the same id (for gold: of the same category too); the
    best premise counts:

    * ``exact``: 1 when an equal (trimmed) statement is on the other side;
    * ``token_overlap``: share of the statement's distinct tokens that one
      statement of the other side holds (0 for a statement without tokens).

    Returns ``(pred_best(category, id, pos, score), gold_best(category, id, pos, score))``;
    gold rows appear for each category that has predictions for the id.
    """
    cats = pred.select("category", "id").distinct()
    gold_c = gold.join(cats, "id")  # gold statements per (category, id) with predictions
    if scorer == "exact":
        pk = pred.select("category", "id", "pos", T.py_strip("statement").alias("s"))
        gk = gold_c.select("category", "id", "pos", T.py_strip("statement").alias("s"))
        gold_set = gold.select("id", T.py_strip("statement").alias("s")).distinct()
        pred_set = pk.select("category", "id", "s").distinct()
        return _exact_best(pk, gold_set, ["id", "s"]), _exact_best(gk, pred_set, ["category", "id", "s"])
    if scorer != "token_overlap":
        raise ValueError(f"unknown scorer {scorer}")
    pt = pred.select("category", "id", "pos", tokens("statement").alias("t"))
    gt = gold_c.select("category", "id", "pos", tokens("statement").alias("t"))
    each = ["category", "id", "pos", "score"]
    return (best_overlap(pt, gold.select("id", tokens("statement").alias("t")), ["id"]).select(*each),
            best_overlap(gt, pt, ["category", "id"]).select(*each))


def _exact_best(rows: DataFrame, premises: DataFrame, keys: list[str]) -> DataFrame:
    """1.0 for the places ``(category, id, pos)`` of ``rows`` with a row that has a premise, else 0.0; a row each.

    A place with several rows has one row of score 1.0 for each pair of a row and one
    that has a premise.  The join is a merge join: statements compress so well that
    their shuffled size would pass for small, and a broadcast goes through the driver.
    """
    place = ["category", "id", "pos"]
    seen = rows.join(premises.withColumn("_hit", F.lit(True)).hint("merge"), keys, "left")
    named = F.col("category").isNotNull() & F.col("id").isNotNull() & F.col("pos").isNotNull()
    n = seen.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_hit").isNotNull() & named).alias("_m"))
    score = F.when(F.col("_m") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return n.select(*place, F.explode(F.array_repeat(score, (F.col("_n") * F.greatest("_m", F.lit(1))).cast("int"))).alias("score"))


def soft_prf(pred_best: DataFrame, gold_best: DataFrame) -> DataFrame:
    """E5: precision = mean of predicted maxima, recall = mean of gold maxima, F1."""
    p = pred_best.groupBy("category", "id").agg(F.avg("score").alias("precision"))
    r = gold_best.groupBy("category", "id").agg(F.avg("score").alias("recall"))
    j = p.join(r, ["category", "id"], "inner")
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return j.select("category", "id", "precision", "recall", f1.alias("f1"))


def discovered_categories(pred: DataFrame) -> list[str]:
    """The categories that have predictions, sorted: one per predicted folder."""
    return [r["category"] for r in pred.select("category").distinct().orderBy("category").collect()]


def per_example(prf: DataFrame, ids: DataFrame, categories: list[str] | DataFrame) -> DataFrame:
    """Every aligned id x every category; a missing prediction scores 0.

    ``categories``: the predictions, whose folders are discovered, or a list of names.
    Categories of ``prf`` outside a given list stay too.  The few names are an array
    spread over each id, not a cross join.
    """
    if isinstance(categories, DataFrame):
        categories = discovered_categories(categories)
    names = sorted({*categories, *discovered_categories(prf)})
    grid = ids.select("id", F.explode(F.array(*[F.lit(c) for c in names]).cast("array<string>")).alias("category"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return grid.join(prf, ["id", "category"], "left").select("id", "category", zero("precision"), zero("recall"), zero("f1"))


def macro_scores(per_ex: DataFrame) -> DataFrame:
    """Per category, mean over ids in percent (Correctness, Completeness, Overall)."""
    return per_ex.groupBy("category").agg(
        F.count(F.lit(1)).cast("bigint").alias("num_examples"),
        (F.avg("precision") * 100).alias("correctness"),
        (F.avg("recall") * 100).alias("completeness"),
        (F.avg("f1") * 100).alias("overall"))


def team_player_aliases(macro: DataFrame) -> DataFrame:
    """Top-level Team / Player numbers (0 when the category is absent)."""
    cols = []
    for cat in ("Team", "Player"):
        for m in ("correctness", "completeness", "overall"):
            cols.append(F.coalesce(F.max(F.when(F.col("category") == cat, F.col(m))), F.lit(0.0))
                        .alias(f"{cat.lower()}_{m}"))
    return macro.agg(*cols)


def error_ledger(scored: DataFrame, ids: DataFrame, error_col: str = "error") -> DataFrame:
    """Aligned ids with a failed record and the first of its errors; the run goes on with the others.

    ``scored`` has one row per record with ``error_col`` (null when it went well), as
    :func:`tabwright.operators.model.call_model` leaves it.
    """
    failed = scored.filter(F.col(error_col).isNotNull()).groupBy("id").agg(F.min(error_col).alias("error"))
    return failed.join(ids.select("id").distinct(), "id", "left_semi")


def without_errors(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ids that are not in the ledger."""
    return rows.join(ledger.select("id"), "id", "left_anti")


# E10 ----------------------------------------------------------------------------------------
def loss_summary(losses: DataFrame, loss_col: str = "loss", n_col: str = "n", group_cols: list[str] | None = None) -> DataFrame:
    """Batch-weighted mean loss, perplexity (inf from 30 up), sample count."""
    group_cols = group_cols or []
    agg = losses.groupBy(*group_cols).agg(F.sum(F.col(loss_col) * F.col(n_col)).alias("_s"),
                                          F.sum(n_col).cast("bigint").alias("num_samples"))
    avg = F.col("_s") / F.greatest(F.col("num_samples"), F.lit(1))
    return agg.select(*group_cols, avg.alias("eval_loss"),
                      F.when(avg < 30, F.exp(avg)).otherwise(F.lit(float("inf"))).alias("eval_ppl"),
                      "num_samples")


# E11 -----------------------------------------------------------------------------------------
def cell_prf(pred_cells: DataFrame, gold_cells: DataFrame, id_col: str = "id") -> DataFrame:
    """Cell-level precision/recall/F1 of ``(id, row_key, column, value)`` multisets."""
    keys = [id_col, "row_key", "column", "value"]
    pc = pred_cells.select(*keys[:3], T.py_strip(F.col("value").cast("string")).alias("value")) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("pc"))
    gc = gold_cells.select(*keys[:3], T.py_strip(F.col("value").cast("string")).alias("value")) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("gc"))
    j = pc.join(gc, keys, "full_outer").fillna(0, ["pc", "gc"])
    s = j.groupBy(id_col).agg(F.sum(F.least("pc", "gc")).alias("tp"), F.sum("pc").alias("np"), F.sum("gc").alias("ng"))
    p = F.when(F.col("np") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("np"))
    r = F.when(F.col("ng") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("ng"))
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return s.select(id_col, p.alias("precision"), r.alias("recall"), f.alias("f1"))


# E12 -----------------------------------------------------------------------------------------
SCHEMA_REWARD_FIELDS = "struct<fields:array<struct<name:string,type:string>>>"


def schema_reward(schema_json, parses, gold_names) -> Column:
    """Four numbers in [0, 1]: parses; distinct non-empty names share;
    allowed-type share; gold coverage."""
    from pyspark.sql.functions import from_json
    f = from_json(_c(schema_json), SCHEMA_REWARD_FIELDS)["fields"]
    f = F.when(_c(parses), f).otherwise(F.array())
    names = F.transform(f, lambda x: F.coalesce(x["name"], F.lit("")))
    n = F.size(names)
    uniq = F.size(F.array_distinct(F.filter(names, lambda x: x != "")))
    typed = F.size(F.filter(f, lambda x: x["type"].isin(*K.SCHEMA_TYPES)))
    gold = F.array_distinct(_c(gold_names))
    cover = F.size(F.array_intersect(F.array_distinct(names), gold))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return F.struct(F.when(_c(parses), F.lit(1.0)).otherwise(F.lit(0.0)).alias("json_valid"),
                    share(uniq, n).alias("unique_names"), share(typed, n).alias("allowed_types"),
                    share(cover, F.size(gold)).alias("coverage"))
