"""Type, enum, key and header-schema induction."""

from pyspark.sql import functions as F

from tabwright.operators import induce


def test_infer_column_types(spark):
    rows = [("2010", "8.8", "true", "2025-06-10", "1", "1e5", " 5", "N/A", "x"),
            ("1972", "9.2", "False", "2025-08", "0", "2", "6", "n/a", None)]
    cols = ["year", "rating", "in_stock", "date", "flag", "sci", "padded", "allmiss", "name"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    got = {r["column_name"]: r for r in induce.infer_column_types(df).collect()}
    assert got["year"]["type"] == "integer"          # integer before date
    assert got["rating"]["type"] == "number"
    assert got["in_stock"]["type"] == "boolean"
    assert got["date"]["type"] == "date"
    assert got["date"]["format"] == "YYYY|YYYY-MM|YYYY-MM-DD"
    assert got["flag"]["type"] == "boolean"          # 0/1 is boolean first
    assert got["sci"]["type"] == "string"            # 1e5 has no dot
    assert got["padded"]["type"] == "string"         # regexes do not trim
    assert got["allmiss"]["type"] == "string"
    assert got["name"]["required"] is False and got["year"]["required"] is True
    assert got["name"]["n_missing"] == 1


def test_small_enums(spark):
    cells = spark.createDataFrame(
        [(1, "area", "City Centre"), (2, "area", "riverside"), (3, "area", "city centre "), (4, "area", "Riverside"),
         (5, "area", "-")] + [(10 + i, "many", f"v{i}") for i in range(11)] + [(30, "one", "x"), (31, "one", "X")],
        "pos long, column_name string, value string")
    got = {r["column_name"]: r for r in induce.small_enums(cells, ["column_name"]).collect()}
    assert got["area"]["n_distinct"] == 2 and got["area"]["enum_values"] == ["City Centre", "riverside"]
    assert got["many"]["n_distinct"] is None and got["many"]["enum_values"] is None
    assert got["one"]["enum_values"] is None          # never an enum of size 1


def test_primary_key_leftmost(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z")], "k string, id string, v string")
    r = induce.detect_primary_key(df).first()
    assert r["key_column"] == "id" and r["n_rows"] == 3
    df2 = spark.createDataFrame([("a", "1"), ("a", None)], "k string, id string")
    assert induce.detect_primary_key(df2).first()["key_column"] is None


def test_header_schema_fields(spark):
    rows = []
    for tpos, (name, heads) in enumerate([("Team", ["Team", "Wins", "Losses", "Total Points"]),
                                          ("Player", ["Player", "Points", "Minutes Played", "Wins"])]):
        for hpos, h in enumerate(heads):
            rows.append((1, tpos, name, hpos, h))
    rows.append((2, 0, "Empty", 0, None))
    h = spark.createDataFrame(rows, "record_id long, table_pos int, table_name string, header_pos int, header string")
    f = induce.header_schema_fields(h).orderBy("record_id", "grp", "p1", "p2").collect()
    got = [(r["name"], r["type"], r["required"]) for r in f if r["record_id"] == 1]
    assert got == [("team_name", "string", True), ("player_name", "string", False), ("team", "string", False),
                   ("wins", "integer", False), ("losses", "integer", False), ("total_points", "integer", False),
                   ("player", "string", False), ("points", "integer", False), ("minutes_played", "integer", False)]
    assert {r["schema_id"] for r in f if r["record_id"] == 1} == {"team_player_schema"}
    assert [(r["name"], r["schema_id"]) for r in f if r["record_id"] == 2] == [("empty_name", "empty_schema")]


def test_minimal_schema_json(spark):
    df = spark.createDataFrame([("ex-1", ["Name", "name", "Price (USD)"])], "id string, h array<string>")
    s = induce.minimal_schema(F.col("id"), F.col("h"))
    r = df.select(s.alias("s"), induce.minimal_schema_json(s).alias("j")).first()
    assert r["s"]["field_names"] == ["name", "name_2", "price_usd"]
    import json
    obj = json.loads(r["j"])
    assert list(obj) == ["schema_id", "structure", "description", "fields"]
    assert obj["fields"][1] == {"name": "name_2", "type": "string", "required": False}
    assert r["j"] == json.dumps(obj, ensure_ascii=False)


def test_infer_types_long_per_group(spark):
    cells = spark.createDataFrame([("t1", "year", "2010"), ("t1", "year", "-"), ("t2", "year", "MMX"),
                                   ("t1", "ok", "yes"), ("t1", "ok", "N")],
                                  "tbl string, column_name string, value string")
    got = {(r["tbl"], r["column_name"]): (r["type"], r["required"])
           for r in induce.infer_types_long(cells, ["tbl", "column_name"]).collect()}
    assert got == {("t1", "year"): ("integer", False), ("t2", "year"): ("string", True),
                   ("t1", "ok"): ("boolean", True)}


def test_types_judged_by_value_equal_types_judged_by_text(spark):
    longs = [(0, 1), (7, None), (1000, 9999), (10000, 1000), (-1, 0), (None, None)]
    doubles = [(0.0, -0.0), (1.0, 1e7), (1.5e-4, 2.0), (float("nan"), 1.0), (float("inf"), None), (2010.0, 1e300)]
    for a, b in zip(longs, doubles):
        df = spark.createDataFrame(list(zip(a, b)), "x long, y double").coalesce(1)
        own = induce.infer_column_types(df).collect()
        text = induce.infer_column_types(df.select(F.col("x").cast("string"), F.col("y").cast("string"))).collect()
        assert own == text, (a, b)


def test_keys_and_enums_of_high_cardinality_columns(spark):
    df = spark.range(20000).select((F.col("id") % 19000).cast("string").alias("nearly"), F.col("id").cast("string").alias("key"),
                                   F.when(F.col("id") > 3, F.col("id")).cast("string").alias("holes"))
    assert induce.detect_primary_key(df).first()["key_column"] == "key"
    assert induce.detect_primary_key(df.drop("key")).first()["key_column"] is None
    assert induce.detect_primary_key(df.limit(0)).first().asDict() == {"key_column": None, "n_rows": 0}
    cells = induce.stack_cells(df.withColumn("i", F.col("key").cast("long")), F.col("i"), ["nearly", "key"])
    cells = cells.unionByName(cells.select("pos", F.lit("ten").alias("column_name"), (F.col("pos") % 10).cast("string").alias("value")))
    got = {r["column_name"]: (r["n_distinct"], r["enum_values"]) for r in induce.small_enums(cells, ["column_name"]).collect()}
    assert got == {"nearly": (None, None), "key": (None, None), "ten": (10, [str(i) for i in range(10)])}


def test_fields_within_the_record_equal_the_long_form(spark):
    rows = [(1, [("Team", ["Team", "Wins", "wins", "Total Points"]), ("Player", ["Player", "Points", "", "--", "Wins"]), ("Team", None)]),
            (2, [("A b", [])]), (3, [("x", ["x name", "a_b name"]), ("X", ["id"])])]
    df = spark.createDataFrame(rows, "record_id long, tables array<struct<name:string,headers:array<string>>>")
    got = induce.with_schema_fields(df, "tables").select("record_id", "schema_id", F.explode("fields").alias("f")).select(
        "record_id", "schema_id", "f.*")
    long = df.select("record_id", F.posexplode("tables").alias("table_pos", "t")).select(
        "record_id", "table_pos", F.col("t.name").alias("table_name"), F.posexplode_outer("t.headers").alias("header_pos", "header"))
    want = induce.header_schema_fields(long).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_enums_aggregate_by_hash_not_by_sorting_rows(spark):
    cells = spark.range(1000).select(F.col("id").alias("pos"), F.lit("c").alias("column_name"),
                                     F.concat(F.lit(" V"), F.col("id") % 3, F.lit(" ")).alias("value"))
    found = induce.small_enums(cells, ["column_name"])
    assert found.collect()[0]["enum_values"] == ["V0", "V1", "V2"]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("HashAggregate" in line and "partial_min(pos" in line for line in plan)     # rows are combined without a sort


def test_every_column_has_its_distinct_count(spark):
    cells = spark.range(3000).select(F.col("id").alias("pos"), F.lit("many").alias("column_name"),
                                     F.concat(F.lit("V"), F.col("id") % 1500, F.when(F.col("id") > 1500, " ").otherwise("")).alias("value"))
    cells = cells.unionByName(spark.createDataFrame([(1, "few", "b"), (2, "few", "a"), (0, "few", "A "), (5, "few", "-"), (6, "none", None)],
                                                    "pos long, column_name string, value string"))
    got = {r["column_name"]: (r["n_distinct"], r["enum_values"]) for r in
           induce.small_enums(cells, ["column_name"], count_all=True).collect()}
    assert got == {"many": (1500, None), "few": (2, ["A", "b"])}


def test_column_enums_counts_columns_with_many_values(spark):
    from tabwright import plans
    from .conftest import SF_SMALL
    got = {r["column_name"]: r["n_distinct"] for r in plans.QUERIES["column_enums"](spark, SF_SMALL).collect()}
    assert got["c_name"] > 10 and got["l_shipdate"] > 10 and None not in got.values()
    assert "n.nd <= 10 THEN n.nd" not in plans.ORACLES["column_enums"]
