"""The corpus pipeline on planted documents: every stage against brute force on its own input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import decontaminate, mixing, near_dedup

from .test_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOP = (1 << 63) - 1


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeglmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(30)
    rows, labels = [], []
    for i in range(600):
        text = prose(rng.randint(8, 80))
        toxic = i % 5 == 0
        if toxic:
            text = text + " " + rng.choice(["grobnik", "grobnak", "grobnos"]) + " you grobnik"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1] + " " + prose(60)
    copies = [base, base] + [base.replace(base.split()[k], "edited", 1) for k in (3, 9)]
    rows += [(1000 + k, t, "en", "s1", len(t)) for k, t in enumerate(copies)]
    rows += [(1100 + k, f"{prose(12)} {passage} {prose(12)}", "en", "s2", 0) for k in range(3)]
    rows += [(None, None, None, None, None), (1200, "", "en", "s3", 0), (TOP, prose(20), "en", "s3", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    held, before = {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before, SCHEMA), sf_dir)
        assert name == "token_output" or out.columns == docs.columns
        held[name], before = (before, out.collect()), out.collect() if name == "mixing" else out.collect()
    kept = {r.doc_id for r in held["toxicity"][1]}
    toxic = {i for i in range(600) if i % 5 == 0}
    assert len(kept & toxic) <= 3 and len(set(range(600)) - toxic - kept) <= 3 and {1000, 1100, 1200, TOP, None} <= kept
    rows = [tuple(r) for r in held["near_dedup"][0]]
    want = sorted(str(i) for i, _, top in brute_components(rows) if i == top)
    assert sorted(str(r.doc_id) for r in held["near_dedup"][1]) == want
    assert not {1001, 1002, 1003} & {r.doc_id for r in held["near_dedup"][1]}
    clean = {r.doc_id for r in held["near_dedup"][1]} - {1100, 1101, 1102}
    assert {r.doc_id for r in held["decontamination"][1]} == clean
    taken = [r for r in held["mixing"][1]]
    assert {tuple(r) for r in taken} <= {tuple(r) for r in held["decontamination"][1]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted((tok.encode(r.text or "", add_special_tokens=False).ids + [2], r.doc_id) for r in held["token_output"][0])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(i), len(x), crc(x)) for x, i in ids) == sorted(
        (str(r.doc_id), r.n_tokens, r.ids_crc32) for r in held["token_output"][1])
    starts = sorted((r.start, r.n_tokens) for r in held["token_output"][1])
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()


def test_run_applies_the_stages_to_the_tables(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and not {r.doc_id for r in rows} & {1001, 1002, 1003, 1100, 1101, 1102}


def test_rows_travel_with_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (2, "a b c d e f", 6), (TOP, "other words here now", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id long").withColumns(
        {c: F.lit("x") for c in ("source", "bad_hash", "row", "hash", "mix", "copies", "__id", "__plan", "id", "nth", "place")})
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[2]) for r in kept.collect()) == [(1, 5), (TOP, 7)]
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [r[0] for r in decontaminate.clean(docs, bench).collect()] == [TOP]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}


def test_the_largest_id_is_an_id(spark):
    rows = [(TOP, "one two three four"), (None, "one two three four"), (None, "five six seven"), (TOP, "lone words of their own"),
            (None, None), (TOP, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(TOP, 3, TOP), (None, 3, TOP), (None, 2, None), (TOP, 4, TOP), (None, 0, None), (TOP, 0, TOP)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))
