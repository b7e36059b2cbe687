"""Evaluation jobs (E1-E12) on hand-traced inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tabwright.operators import evaluate as EV

SCHEMA = '[SCHEMA]\n{"fields": [{"name": "a", "type": "integer"}, {"name": "b", "type": "string"}]}\n<|document|>'


def test_sanity_report_fixture(spark):
    gens = ['{"a": "1", "b": "x"}', '{"a": 1, "b": ', '{"b": "x", "a": "1"}', "   ", "", '{"a": "x", "b": "y"}']
    df = spark.createDataFrame([(i, [("user", SCHEMA)], g, None) for i, g in enumerate(gens)],
                               "k long, messages array<struct<role:string,content:string>>, generation_only string, "
                               "generation string")
    flags = EV.sanity_flags(df, "k")
    rep = EV.sanity_report(flags).first()
    assert rep["samples"] == 5
    assert rep["json_valid_rate"] == pytest.approx(4 / 5)
    assert rep["key_order_pass_rate"] == pytest.approx(3 / 5)
    assert rep["type_check_pass_rate"] == pytest.approx(3 / 5)
    fails = [(r["sample"], r["reason"]) for r in EV.sanity_failures(flags, "k").collect()]
    assert fails == [(1, "json_parse_error"), (2, "key_order_mismatch"), (5, "type_mismatch")]


def test_types_checked_only_before_first_key_mismatch(spark):
    g = '{"b": "x", "a": "1"}\n{"a": "bad", "b": "y"}'
    df = spark.createDataFrame([(0, [("user", SCHEMA)], g, None)],
                               "k long, messages array<struct<role:string,content:string>>, generation_only string, "
                               "generation string")
    r = EV.sanity_flags(df, "k").first()
    assert (r["json_ok"], r["keys_ok"], r["types_ok"]) == (True, False, True)


def _prf(spark, pred, gold, scorer):
    p = spark.createDataFrame(pred, "category string, id string, pos long, statement string")
    g = spark.createDataFrame(gold, "id string, pos long, statement string")
    pb, gb = EV.best_scores(p, g, scorer)
    return {(r["category"], r["id"]): r for r in EV.soft_prf(pb, gb).collect()}


def test_soft_prf_exact(spark):
    r = _prf(spark, [("Team", "1", 0, "a"), ("Team", "1", 1, "b")], [("1", 0, "a")], "exact")[("Team", "1")]
    assert (r["precision"], r["recall"]) == (0.5, 1.0) and r["f1"] == pytest.approx(2 / 3)


def test_soft_prf_token_overlap_against_the_other_set(spark):
    # each statement is the hypothesis; the other side's statements of the id are the premise
    r = _prf(spark, [("T", "1", 0, "the red car"), ("T", "1", 1, "")],
             [("1", 0, "red car"), ("1", 1, "blue boat"), ("2", 0, "the")], "token_overlap")[("T", "1")]
    assert r["precision"] == pytest.approx((2 / 3 + 0.0) / 2)   # 'the' is only in another id's gold
    assert r["recall"] == pytest.approx((1.0 + 0.0) / 2)


def test_exact_scorer_pairs_free(spark):
    r = _prf(spark, [("T", "1", 0, " a "), ("T", "1", 1, "a"), ("U", "1", 0, "b")],
             [("1", 0, "a"), ("1", 1, "c")], "exact")
    assert (r[("T", "1")]["precision"], r[("T", "1")]["recall"]) == (1.0, 0.5)
    assert (r[("U", "1")]["precision"], r[("U", "1")]["recall"]) == (0.0, 0.0)


def test_per_example_zero_fill_and_macro(spark):
    prf = spark.createDataFrame([("Team", "1", 1.0, 0.5, 2 / 3)],
                                "category string, id string, precision double, recall double, f1 double")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    ex = EV.per_example(prf, ids, ["Team", "Player"])
    assert ex.count() == 4
    m = {r["category"]: r for r in EV.macro_scores(ex).collect()}
    assert m["Team"]["correctness"] == pytest.approx(50.0) and m["Player"]["overall"] == 0.0
    a = EV.team_player_aliases(EV.macro_scores(ex)).first()
    assert a["team_completeness"] == pytest.approx(25.0)


def test_loss_summary(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, 4), (40.0, 0)], "loss double, n long")
    r = EV.loss_summary(df).first()
    assert r["eval_loss"] == 1.5 and r["eval_ppl"] == pytest.approx(math.exp(1.5)) and r["num_samples"] == 8
    big = EV.loss_summary(spark.createDataFrame([(31.0, 1)], "loss double, n long")).first()
    assert math.isinf(big["eval_ppl"])


def test_cell_prf(spark):
    gold = spark.createDataFrame([("t", "r1", "c", "x"), ("t", "r1", "d", "1"), ("t", "r2", "c", "y")],
                                 "id string, row_key string, column string, value string")
    pred = spark.createDataFrame([("t", "r1", "c", " x "), ("t", "r2", "c", "z")],
                                 "id string, row_key string, column string, value string")
    r = EV.cell_prf(pred, gold).first()
    assert (r["precision"], r["recall"]) == (0.5, pytest.approx(1 / 3))


def test_schema_reward(spark):
    js = '{"fields": [{"name": "a", "type": "string"}, {"name": "a", "type": "money"}, {"name": "", "type": "date"}]}'
    df = spark.createDataFrame([(js, True, ["a", "b"]), ("{", False, ["a"])], "j string, ok boolean, g array<string>")
    rows = df.select(EV.schema_reward(F.col("j"), F.col("ok"), F.col("g")).alias("r")).collect()
    r = rows[0]["r"]
    assert (r["json_valid"], r["unique_names"], r["allowed_types"], r["coverage"]) == (
        1.0, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5)
    assert rows[1]["r"]["json_valid"] == 0.0


def test_best_single_statement_not_the_union(spark):
    r = _prf(spark, [("T", "1", 0, "a b"), ("T", "1", 1, "a b c d")],
             [("1", 0, "a c"), ("1", 1, "b d"), ("1", 2, "")], "token_overlap")[("T", "1")]
    assert r["precision"] == pytest.approx((0.5 + 0.5) / 2)
    assert r["recall"] == pytest.approx((1.0 + 1.0 + 0.0) / 3)


def test_best_overlap_equals_all_pairs(spark):
    import random

    from tabwright.operators.overlap import best_overlap
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]

    def rows(n):
        return [(rng.choice(["x", "x", "y"]), i, sorted(set(rng.choices(words, weights, k=rng.randint(0, 16))))) for i in range(n)]

    mine, others = rows(150) + [("x", 900, ["w0"]), ("z", 901, ["w1"])], rows(120)
    mine += [("x", 1000 + i, mine[0][2]) for i in range(20)]          # equal statements
    got = best_overlap(spark.createDataFrame(mine, "g string, i long, t array<string>"),
                       spark.createDataFrame(others, "g string, i long, t array<string>"), ["g"])
    want = {i: max([len(set(t) & set(o)) / len(t) for h, _, o in others if h == g], default=0.0) if t else 0.0 for g, i, t in mine}
    assert {r["i"]: r["score"] for r in got.collect()} == want
    none = spark.createDataFrame([], "g string, i long, t array<string>")
    assert {r["score"] for r in best_overlap(got.select("g", "i", "t"), none, ["g"]).collect()} == {0.0}


def test_categories_are_discovered(spark):
    prf = spark.createDataFrame([("Team", "1", 1.0, 0.5, 0.6)], "category string, id string, precision double, recall double, f1 double")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    pred = spark.createDataFrame([("Team", "1"), ("Odd One", "9")], "category string, id string")
    got = {(r["id"], r["category"]): r["precision"] for r in EV.per_example(prf, ids, pred).collect()}
    assert got == {("1", "Team"): 1.0, ("2", "Team"): 0.0, ("1", "Odd One"): 0.0, ("2", "Odd One"): 0.0}
    assert {r["category"] for r in EV.per_example(prf, ids, ["Player"]).collect()} == {"Player", "Team"}


def test_error_ledger_and_the_rest_of_the_run(spark):
    scored = spark.createDataFrame([("1", "E: a"), ("1", None), ("2", None), ("3", "E: b"), ("3", "E: a")], "id string, error string")
    ids = spark.createDataFrame([("1",), ("2",), ("1",)], "id string")
    ledger = EV.error_ledger(scored, ids)
    assert [tuple(r) for r in ledger.collect()] == [("1", "E: a")]
    assert [r["id"] for r in EV.without_errors(ids, ledger).collect()] == ["2"]


def test_exact_scores_are_joined_without_a_broadcast(spark):
    pred = spark.createDataFrame([("Team", 1, 0, "a "), ("Team", 1, 1, "b"), ("Team", 1, 2, "a"), ("Team", 1, 2, "z"), ("Team", 2, None, "c"),
                                  ("Team", None, 3, "a")], "category string, id long, pos long, statement string")
    gold = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (2, 0, "c")], "id long, pos long, statement string")
    pb, gb = EV.best_scores(pred, gold, scorer="exact")
    assert "BroadcastHashJoin" not in pb._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["id"] or 0, -1 if r["pos"] is None else r["pos"], r["score"]) for r in pb.collect()))
    assert got == [(0, 3, 0.0), (1, 0, 1.0), (1, 1, 0.0), (1, 2, 1.0), (1, 2, 1.0), (2, -1, 0.0)]
    assert sorted((r["id"], r["pos"], r["score"]) for r in gb.collect()) == [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0)]
