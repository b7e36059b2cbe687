"""Sources and sinks on small files written by the tests."""

import bz2
import gzip
import os
import tempfile

import pytest
import zstandard
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabwright.sources import files as SF
from tabwright.sources import jsonl as SJ

SCHEMA = "a long, b string"
LINES = ['{"a": 1}', "", "   ", '{"a": 2, "b": "x"}', "not json", '{"a": 3}']


def _dir():
    return tempfile.mkdtemp(prefix="tw-test-", dir="/tmp")


def _write(path, opener=open, mode="wt"):
    with opener(path, mode) as f:
        f.write("\n".join(LINES) + "\n")


def test_lenient_skips_blank_and_bad(spark):
    d = _dir()
    _write(f"{d}/x.jsonl")
    got = SJ.read_jsonl_lenient(spark, f"{d}/x.jsonl", SCHEMA).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, None), (2, "x"), (3, None)]


def test_strict_reports_path_and_line(spark):
    d = _dir()
    _write(f"{d}/x.jsonl")
    with pytest.raises(SJ.StrictJsonError, match=r"x\.jsonl:5: invalid JSON"):
        SJ.read_jsonl_strict(spark, f"{d}/x.jsonl", SCHEMA)
    rej = SJ.jsonl_rejects(spark, f"{d}/x.jsonl").collect()
    assert [(r["line_no"], r["line"]) for r in rej] == [(5, "not json")]


def test_validity_is_apart_from_typing(spark):
    d = _dir()
    lines = ['{"a": "2"}', '{"a": 6.5}', "{'a': 4}", '{"a": 5} trailing', '{"a": 1}', '{"a": 1}}', '{"a": 1, "a": 2}',
             '{"a": NaN}', '[1]', 'null', '{"a": {"x": 1}, "b": {"y": [1, "\u00e9"]}, "c": null}']
    with open(f"{d}/t.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    rec = SJ.with_fields(SJ.read_records(spark, f"{d}/t.jsonl"), SCHEMA).orderBy("line_no").collect()
    assert [r["line_no"] for r in rec if r["bad"]] == [3, 4, 6]
    got = {r["line_no"]: (r["a"], r["b"], sorted(r["extra"] or {})) for r in rec if not r["bad"]}
    assert got == {1: (2, None, []), 2: (None, None, []), 5: (1, None, []), 7: (2, None, []), 8: (None, None, []),
                   9: (None, None, []), 10: (None, None, []), 11: (None, '{"y":[1,"\u00e9"]}', ["c"])}
    assert {r["line_no"]: str(r["record"]) for r in rec}[2] == '{"a":6.5}'
    obs = Observation()
    assert SJ.read_jsonl_lenient(spark, f"{d}/t.jsonl", SCHEMA, obs).count() == 8
    assert obs.get == {"n_lines": 11, "n_bad": 3}


def test_nested_mistyped_field_loses_itself_only(spark):
    df = spark.createDataFrame([('{"s": {"n": "x", "t": "ok", "l": [1, "2", {"z": 1}]}}',)], "line string")
    r = SJ.with_fields(SJ.with_records(df), "s struct<n:int,t:string,l:array<int>>").first()
    assert r["s"].asDict() == {"n": None, "t": "ok", "l": [1, 2, None]}


def test_unknown_fields_pass_a_stage(spark):
    import json
    d = _dir()
    rows = [{"a": 1, "b": "\u00e9\U0001f600", "u": {"k": [1, None]}, "w": None}, {"a": 2, "b": None}]
    with open(f"{d}/t.jsonl", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    df = SJ.read_jsonl_lenient(spark, f"{d}/t.jsonl", SCHEMA).drop("file_path", "file_name")
    for ascii_only in (False, True):
        SJ.write_jsonl(df.withColumn("n", F.lit(7)), f"{d}/out{ascii_only}", ascii_only=ascii_only)
        lines = [r["line"] for r in SJ.read_lines(spark, f"{d}/out{ascii_only}").collect()]
        assert sorted((json.loads(x) for x in lines), key=lambda r: r["a"]) == [r | {"n": 7} for r in rows]
        assert all(x.isascii() for x in lines) == ascii_only
    SJ.write_jsonl(df.drop("extra"), f"{d}/parts", ["a"], compression="gzip")
    assert sorted(os.path.basename(x) for x in os.listdir(f"{d}/parts") if x.startswith("a=")) == ["a=1", "a=2"]


def test_default_ids_are_zero_based_line_numbers(spark):
    d = _dir()
    with open(f"{d}/t.jsonl", "w") as f:
        f.write('{"x": 1}\n\n{"id": 9}\nbroken\n{"id": null}\n{"x": 2}\n')
    rec = SJ.with_default_id(SJ.read_records(spark, f"{d}/t.jsonl")).filter(~F.col("bad")).orderBy("line_no")
    assert [r["id"] for r in rec.collect()] == ["0", "9", None, "5"]


@pytest.mark.parametrize("suffix", ["txt", "gz", "bz2", "zst"])
def test_undecodable_bytes_are_dropped(spark, suffix):
    raw = (b'{"a":1,"b":"x\xffy"}\n{"a":2,"b":"\xef\xbf\xbd\xe2\x82z"}\n\xfe\n{"a":3,"b":"\x10b"}\n'
           b'{"a":4,"b":"\xed\xa0\x80\xc0\x80\xf5"}\n')
    d = _dir()
    data = {"txt": bytes, "gz": gzip.compress, "bz2": bz2.compress,
            "zst": zstandard.ZstdCompressor().compress}[suffix](raw)
    with open(f"{d}/x.{suffix}", "wb") as f:
        f.write(data)
    got = [r["line"] for r in SJ.numbered_lines(spark, f"{d}/x.{suffix}").orderBy("line_no").collect()]
    assert got == raw.decode("utf-8", "ignore").splitlines()
    want = {1: "xy", 2: "\ufffdz", 4: ""}                        # a control character in a string is no JSON
    assert {r["a"]: r["b"] for r in SJ.read_jsonl_lenient(spark, f"{d}/x.{suffix}", SCHEMA).collect()} == want


@pytest.mark.parametrize("suffix", ["gz", "bz2", "zst"])
def test_compressed(spark, suffix):
    d = _dir()
    p = f"{d}/x.jsonl.{suffix}"
    if suffix == "gz":
        _write(p, gzip.open)
    elif suffix == "bz2":
        _write(p, bz2.open)
    else:
        with open(p, "wb") as f:
            f.write(zstandard.ZstdCompressor().compress(("\n".join(LINES) + "\n").encode()))
    assert SJ.read_jsonl_lenient(spark, p, SCHEMA).count() == 3


def test_zstd_sink_round_trip(spark):
    d = _dir()
    df = spark.range(100).select(F.to_json(F.struct(F.col("id").alias("a"))).alias("value")).repartition(3)
    assert SJ.write_text_zstd(df, f"{d}/z") == 100
    assert SJ.read_jsonl_lenient(spark, f"{d}/z/*.zst", SCHEMA).agg(F.sum("a")).first()[0] == sum(range(100))


def _tree(root, files):
    for rel, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as f:
            f.write(text)


def test_statement_dir_root_is_team_without_team_folder(spark):
    d = _dir()
    _tree(d, {"1.txt": "Statements:\n1. a", "2.txt": "x", "player_stats/1.txt": "y", "notes.md": "skip"})
    got = sorted((r["category"], r["id"]) for r in SF.read_statement_dir(spark, d).collect())
    assert got == [("Player Stats", "1"), ("Team", "1"), ("Team", "2")]
    counts = {r["category"]: r["n_files"] for r in SF.count_files(SF.read_statement_dir(spark, d)).collect()}
    assert counts == {"Player Stats": 1, "Team": 2}


def test_statement_dir_team_folder_wins(spark):
    d = _dir()
    _tree(d, {"1.txt": "root", "team/1.txt": "folder", "run.v2.txt": "id keeps inner dots"})
    got = sorted((r["category"], r["id"], r["text"]) for r in SF.read_statement_dir(spark, d).collect())
    assert got == [("Team", "1", "folder")]


@pytest.mark.parametrize("name,split", [("merged_train.jsonl", "train"), ("constraints.jsonl", "train"),
                                        ("x_dev.jsonl", "validation"), ("TEST.jsonl.gz", "test"),
                                        ("valid.jsonl", "data")])
def test_split_routing(spark, name, split):
    r = spark.createDataFrame([(name,)], "n string").select(SF.split_from_name("n").alias("s"),
                                                             SF.output_name("n").alias("o")).first()
    assert r["s"] == split
    assert r["o"] == name.replace(".jsonl.gz", "").replace(".jsonl", "") + "_stage2_messages"


def test_materialize_reuses_and_rebuilds(spark):
    d = _dir()
    path = f"{d}/cache"
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    assert SF.materialize(build, spark, path).count() == 5
    assert SF.materialize(build, spark, path).count() == 5
    assert len(calls) == 1
    assert SF.parquet_rows(spark, f"{d}/missing") == 0
    with pytest.raises(SF.EmptyCacheError):
        SF.materialize(lambda: spark.range(0), spark, f"{d}/empty")


def test_line_numbers_with_interleaved_splits(spark):
    d = _dir()
    for name, n in (("a.jsonl", 40), ("b.jsonl", 25)):
        with open(f"{d}/{name}", "w") as f:
            f.write("\n".join(f'{{"a": {i}, "b": "{name}-{i:03d}"}}' for i in range(1, n + 1)) + "\n")
    old = (spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")   # splits of the two files interleave
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert SJ.read_lines(spark, [f"{d}/a.jsonl", f"{d}/b.jsonl"]).rdd.getNumPartitions() > 4
        got = SJ.numbered_lines(spark, [f"{d}/a.jsonl", f"{d}/b.jsonl"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    import json as _json
    assert len(got) == 65
    for r in got:
        assert _json.loads(r["line"])["a"] == r["line_no"], (r["file_path"], r["line_no"], r["line"])


def test_materialize_rebuilds_a_cache_without_commit_marker(spark, tmp_path):
    import os

    path = str(tmp_path / "cache")
    assert SF.materialize(lambda: spark.range(2), spark, path).count() == 2
    assert SF.materialize(lambda: spark.range(10), spark, path).count() == 2
    os.remove(f"{path}/_SUCCESS")
    assert SF.materialize(lambda: spark.range(10), spark, path).count() == 10


def test_statement_paths_are_decoded(spark):
    d = _dir() + "/st dir+100%é"
    _tree(d, {"1 a.txt": "x", "pläyer one/b+c%20.txt": "y", "pläyer one/.hidden": "", "deep/er/1.txt": "no", "v.1.txt": "z"})
    got = sorted((r["folder"], r["id"], r["text"]) for r in SF.read_statement_dir(spark, d).collect())
    assert got == [("", "1 a", "x"), ("", "v.1", "z"), ("pläyer one", "b+c%20", "y")]
    rows = spark.createDataFrame([("Tab One", "a/b c", "t1"), (None, "\u00e9=%", "t2"), ("Tab One", "", None)],
                                 "category string, id string, text string")
    SF.write_statement_dir(rows, d + "/rows out")
    got = sorted((r["folder"], r["id"], r["text"]) for r in SF.read_statement_rows(spark, d + "/rows out").collect() if r["id"])
    assert got == [("", "\u00e9=%", "t2"), ("tab_one", "a/b c", "t1")]


def test_parquet_rows_of_missing_and_broken_paths(spark):
    d = _dir()
    assert SF.parquet_rows(spark, f"{d}/none") == 0
    os.makedirs(f"{d}/empty")
    assert SF.parquet_rows(spark, f"{d}/empty") == 0
    _tree(d, {"junk/part-0.parquet": "not parquet at all"})
    assert SF.parquet_rows(spark, f"{d}/junk") == 0
    spark.range(3).write.parquet(f"{d}/ok")
    assert SF.parquet_rows(spark, f"{d}/ok") == 3


def test_statement_files_are_laid_out_as_sparks_writer_does_and_written_by_many_tasks(spark):
    import glob
    odd = ["n/é +%1", "a=b:c", "q\"'#*?\\{[]^\x7f\t", "", None, " x.y "]
    rows = [(f, i, f"{f}-{i}") for f in (None, "assistant", "sys/tem 100%", "") for i in odd]
    rows += [("assistant", str(k), f"Statements:\n1. s{k}\n") for k in range(200)] + [("assistant", "0", None)]
    df = spark.createDataFrame(rows, "folder string, id string, text string").coalesce(1)
    d = _dir() + "/a root + 100%"
    SF.write_statement_files(df, f"{d}/new")
    plain = df.withColumnRenamed("text", "value")
    plain.filter("folder is not null").write.partitionBy("folder", "id").text(f"{d}/old")
    plain.filter("folder is null").drop("folder").write.mode("append").partitionBy("id").text(f"{d}/old")

    def files(root):
        out = {}
        for p in glob.glob(f"{root}/**/*.txt", recursive=True):
            with open(p, newline="") as f:
                out.setdefault(os.path.dirname(p)[len(root):], []).extend(sorted(f.read().split("\n")))
        return out
    assert files(f"{d}/new") == files(f"{d}/old")
    found = glob.glob(f"{d}/new/**/*", recursive=True, include_hidden=True)
    names = [os.path.basename(p) for p in found if os.path.isfile(p)]
    assert len(names) == len(files(f"{d}/new")) + 1 and "_SUCCESS" in names       # one file each, nothing temporary
    assert len({n.split("-")[1] for n in names if n != "_SUCCESS"}) > 4           # few bytes, yet not one task
    key = lambda root: sorted(map(str, SF.read_statement_dir(spark, root).select("category", "id").distinct().collect()))
    assert key(f"{d}/new") == key(f"{d}/old")


def test_rows_of_one_statement_file_follow_their_order(spark):
    d = _dir() + "/files"
    rows = spark.createDataFrame([(None, "1", "b", None), (None, "1", "a", "user"), ("x", "1", "c", None)],
                                 "folder string, id string, text string, role string")
    SF.write_statement_files(rows, d, order_col="role")
    got = sorted((r["folder"], r["id"], r["text"]) for r in SF.read_statement_dir(spark, d).collect())
    assert got == [("", "1", "a\nb\n"), ("x", "1", "c\n")]
