"""Scalar functions (F1-F17) against hand-traced values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabwright.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("v,expected", [
    (None, True), ("", True), ("  N/A ", True), ("—", True), ("Unknown", True), ("tbd", True),
    ("x", False), ("0", False), ("none ", True)])
def test_is_missing(spark, v, expected):
    assert one(spark, T.is_missing(F.col("v")), v) is expected


def test_is_missing_na_token(spark):
    assert one(spark, T.is_missing(F.col("v"), na_token="n.d."), " N.D. ") is True


@pytest.mark.parametrize("v,expected", [
    ("priceUSD", "priceusd"), ("hasFreeWifi", "hasfreewifi"), ("eventName", "eventname"),
    (" Price (USD) ", "price_usd"), ("数量", "field"), ("", "field"), (None, "field"), ("__a__b__", "a_b")])
def test_snake_case(spark, v, expected):
    assert one(spark, T.snake_case(F.col("v")), v) == expected


@pytest.mark.parametrize("v,expected", [("数量", ""), ("Total  Points", "total_points"), ("Minutes Played", "minutes_played")])
def test_snake_case_plain(spark, v, expected):
    assert one(spark, T.snake_case_plain(F.col("v")), v) == expected


def test_unique_names_collision_kept(spark):
    r = one(spark, T.unique_names(F.col("v")), ["a", "a", "a_2", "b", "a"], "v array<string>")
    assert r == ["a", "a_2", "a_2", "b", "a_3"]


def test_schema_id_matches_sha1(spark):
    names = ["name", "eat_type"]
    got = one(spark, T.schema_id(F.lit("rest-1::pivot"), F.lit("flat_single_row"), F.col("v")), names,
              "v array<string>")
    want = "auto." + hashlib.sha1("rest-1::pivot|flat_single_row|name|eat_type".encode()).hexdigest()[:12]
    assert got == want


def test_number_lines(spark):
    assert one(spark, T.number_lines(F.col("v")), ["x", "y"], "v array<string>") == "1. x\n2. y"


@pytest.mark.parametrize("v,kind,s,i", [
    ("None", None, None, None), ("null", None, None, None), ("  ", None, None, None),
    (" 5 ", "int", None, 5), ("+5", "int", None, 5), ("-3", "int", None, -3),
    ("5.0", "str", "5.0", None), ("1_000", "str", "1_000", None), ("Thunder", "str", "Thunder", None)])
def test_convert_cell(spark, v, kind, s, i):
    r = one(spark, T.convert_cell(F.col("v")), v)
    if kind is None:
        assert r is None
    else:
        assert (r["kind"], r["s"], r["i"]) == (kind, s, i)


@pytest.mark.parametrize("v,expected", [
    ("player_stats", "Player Stats"), ("team", "Team"), ("PLAYER", "Player"), ("__", "__"), ("a__b", "A B")])
def test_category_display_name(spark, v, expected):
    assert one(spark, T.category_display_name(F.col("v")), v) == expected


def test_safe_table_name(spark):
    assert one(spark, T.safe_table_name(F.col("v")), "Player Stats") == "player_stats"


def test_structures(spark):
    assert one(spark, T.structure_schema_stage(F.col("v")), ["Slot", "Value"], "v array<string>") == "kv_single"
    assert one(spark, T.structure_schema_stage(F.col("v")), ["a", "value"], "v array<string>") == "flat_single_row"
    assert one(spark, T.structure_table_stage(F.col("v")), ["Slot", "VALUE"], "v array<string>") == "kv_multi"
    assert one(spark, T.structure_table_stage(F.col("v")), ["key", "value"], "v array<string>") == "flat_single_row"


@pytest.mark.parametrize("v,expected", [("width", "string"), ("points", "integer"), ("Team", "string")])
def test_guess_header_type(spark, v, expected):
    assert one(spark, T.guess_header_type(F.col("v")), v) == expected


def test_json_string_escapes_like_python(spark):
    import json
    v = 'a"b\\c\n\té '
    assert one(spark, T.json_string(F.col("v")), v) == json.dumps(v, ensure_ascii=False)


@pytest.mark.parametrize("v", ["a\r\nb\n", "", "\n", "a\n\nb", "x\x0by\x1cz", "tail\r"])
def test_py_lines(spark, v):
    assert one(spark, T.py_lines(F.col("v")), v) == v.splitlines()


@pytest.mark.parametrize("v", ["  x 　", "\x1c\ty\n", "  ", "a b"])
def test_py_strip(spark, v):
    assert one(spark, T.py_strip(F.col("v")), v) == v.strip()


@pytest.mark.parametrize("v,isint,isnum,isdate", [
    ("5", True, True, False), ("2010", True, True, True), ("1e5", False, False, False), ("1.e5", False, True, False),
    (" 5", False, False, False), ("2025-06-10", False, False, True), ("8.8", False, True, False),
    ("5\n", True, True, False), ("1.5\n", False, False, False)])
def test_value_classes(spark, v, isint, isnum, isdate):
    r = spark.createDataFrame([(v,)], "v string").select(
        T.is_int_text("v").alias("i"), T.is_number_text("v").alias("n"), T.is_date_text("v").alias("d")).first()
    assert (r["i"], r["n"], r["d"]) == (isint, isnum, isdate)


@pytest.mark.parametrize("v", ["plain", "tail\n", 'q"uote', "back\\slash", "tab\there", "\x01", "é ü  ", ""])
def test_json_string_fast_path_matches_python(spark, v):
    import json
    assert one(spark, T.json_string(F.col("v")), v) == json.dumps(v, ensure_ascii=False)
