"""Merged examples end to end: JSONL -> validation -> schema and table stage rows -> routing."""

import json
import tempfile

from pyspark.sql import functions as F

from tabwright.operators import messages, validate
from tabwright.sources import files as SF
from tabwright.sources import jsonl as SJ

# Our own fixture records (invented content).
RECORDS = [
    {"id": "shop-1::kv", "split": "train", "text": "The Blue Kettle sells tea in the old town.",
     "schema": {"table_id": "shop_kv", "columns": [{"name": "slot", "path": ["slot"]},
                                                   {"name": "value", "path": ["value"]}], "n_cols": 2},
     "table": {"table_id": "shop_kv", "columns": [{"name": "slot"}, {"name": "value"}],
               "data": [["name", "The Blue Kettle"], ["goods", " tea "], ["area", None]]}},
    {"id": "shop-1::pivot", "split": "train", "text": "The Blue Kettle sells tea in the old town.",
     "schema": {"table_id": "shop_pivot", "columns": [{"name": "shopName"}, {"name": "Area (old)"}], "n_cols": 2},
     "table": {"table_id": "shop_pivot", "columns": [{"name": "Area (old)"}, {"name": "shopName"}],
               "data": [["old town", "The Blue Kettle"], ["short"]]}},
]


def _write():
    d = tempfile.mkdtemp(prefix="tw-ex-", dir="/tmp")
    with open(f"{d}/shops_train.jsonl", "w") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS) + "\n\n")
    return d


def test_merged_examples_to_stage_rows(spark):
    d = _write()
    ex = SJ.read_merged_examples(spark, f"{d}/shops_train.jsonl", strict=True)
    assert validate.with_violations(ex).filter(F.size("violations") > 0).count() == 0
    tbl = {r["id"]: r for r in messages.table_stage_from_examples(ex).collect()}
    kv = tbl["shop-1::kv"]["messages"][2]["content"].split("\n")
    assert kv == ['{"slot": "name", "value": "The Blue Kettle"}', '{"slot": "goods", "value": "tea"}',
                  '{"slot": "area", "value": ""}']
    pv = tbl["shop-1::pivot"]["messages"][2]["content"].split("\n")
    assert pv == ['{"shopName": "The Blue Kettle", "Area (old)": "old town"}', '{"shopName": "", "Area (old)": "short"}']
    assert json.loads(tbl["shop-1::kv"]["prompt_schema"])["structure"] == "kv_multi"
    assert tbl["shop-1::kv"]["metadata"]["split"] == "train"
    sch = {r["id"]: r for r in messages.schema_stage_from_examples(ex).collect()}
    a = json.loads(sch["shop-1::pivot"]["messages"][2]["content"])
    assert [f["name"] for f in a["fields"]] == ["shopname", "area_old"] and a["structure"] == "flat_single_row"
    assert json.loads(sch["shop-1::kv"]["messages"][2]["content"])["structure"] == "kv_single"
    routed = ex.select(SF.split_from_name("file_name").alias("s"), SF.output_name("file_name").alias("o")).first()
    assert (routed["s"], routed["o"]) == ("train", "shops_train_stage2_messages")


def test_render_ndjson_duplicate_table_columns_last_wins(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "a"], [["1", "2", "3"], ["4"]])],
                               "s array<string>, t array<string>, d array<array<string>>")
    nd = df.select(messages.render_ndjson("s", "t", "d").alias("x")).first()["x"]
    assert nd.split("\n") == ['{"a": "3", "b": "2"}', '{"a": "", "b": ""}']
