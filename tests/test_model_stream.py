"""Model-call jobs (G1-G3) with stand-in callables and the incremental run."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tabwright.operators import model as MD
from tabwright.streaming import run_incremental


def test_call_model_skips_null_prompts(spark):
    def fn(prompts):   # runs in the executors: it refuses a null prompt
        if any(p is None for p in prompts):
            raise ValueError("null prompt reached the model")
        return [f"  {p.upper()}  " for p in prompts]
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, p string").coalesce(1)
    got = {r["k"]: r["out"] for r in MD.call_model(df, "p", fn, "out", batch_size=1).collect()}
    assert got == {1: "A", 2: None, 3: "C"}


def test_call_model_missing_output_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string").coalesce(1)
    with pytest.raises(Exception, match="outputs for"):
        MD.call_model(df, "p", lambda ps: ps[:1], "out").collect()


def test_chain(spark):
    df = spark.createDataFrame([(1, "Alpha beta.\n\nGamma delta"), (2, "   ")], "k long, text string")
    res = MD.run_chain(df, "k", "text", MD.echo_statements, MD.first_word_schema, MD.statement_table,
                       workdir=tempfile.mkdtemp(prefix="tw-chain-", dir="/tmp"))
    st = {r["k"]: r["atomic_statements"] for r in res["stage3"].collect()}
    assert st == {1: ["Alpha beta.", "Gamma delta"], 2: []}
    fields = [r["name"] for r in res["fields"].filter("k = 1").orderBy("grp", "p1", "p2").collect()]
    assert fields == ["doc_name", "alpha", "gamma"]
    sch = res["schema"].filter("k = 1").first()["schema"]
    assert sch["schema_id"] == "doc_schema" and [f["name"] for f in sch["fields"]] == fields
    assert res["rows"].filter("k = 1").count() == 2
    assert "text" in res["stage3"].columns          # input fields are carried through


def test_incremental_run_processes_new_files_once(spark):
    root = tempfile.mkdtemp(prefix="tw-stream-", dir="/tmp")
    schema = "k long, text string"
    spark.createDataFrame([(1, "a\nb")], schema).write.mode("append").parquet(f"{root}/in")

    def transform(src):
        return src.select("k", F.size(F.split("text", "\n")).alias("n"))
    out = run_incremental(spark, f"{root}/in", schema, transform, f"{root}/out", f"{root}/ck")
    assert out.count() == 1
    spark.createDataFrame([(2, "c")], schema).write.mode("append").parquet(f"{root}/in")
    out = run_incremental(spark, f"{root}/in", schema, transform, f"{root}/out", f"{root}/ck")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(1, 2), (2, 1)]


def counting():
    """A model class that goes to the workers by value; it counts its constructions in a folder that the test reads."""
    class Counting:
        def __init__(self, folder):
            import os
            import uuid
            self.calls = 0
            open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def __call__(self, prompts):
            self.calls += 1
            if "flaky" in prompts and self.calls == 1:
                raise OSError("first call")
            if "bad" in prompts:
                raise ValueError("cannot read bad")
            return [p.upper() for p in prompts]

    return Counting


def test_model_is_set_up_once_per_worker_and_errors_are_rows(spark, tmp_path):
    import os
    factory = MD.ModelFactory(counting(), (str(tmp_path),), key=f"counting-{tmp_path}")
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["flaky", "a", "bad", None, "b"])], "k long, p string").coalesce(1)
    for _ in range(3):
        got = {r["k"]: (r["out"], r["error"]) for r in
               MD.call_model(df, "p", factory, "out", batch_size=5, retries=1, error_col="error").collect()}
        assert got == {0: ("FLAKY", None), 1: ("A", None), 2: (None, "ValueError: cannot read bad"), 3: (None, None), 4: ("B", None)}
    pids = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert len(pids) == len(set(pids))                 # a worker built it once, whatever the number of tasks
    with pytest.raises(Exception, match="cannot read bad|first call"):
        MD.call_model(df, "p", factory, "out").collect()


def test_arriving_files_do_not_grow_in_number_with_the_table():
    from tabwright.plans.io_queries import records_per_file
    assert [records_per_file(n) for n in (0, 1000, 25_600)] == [200, 200, 200]
    for n in (25_601, 500_000, 3_000_000):
        assert -(-n // records_per_file(n)) <= 128
