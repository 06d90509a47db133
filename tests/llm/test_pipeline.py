"""Registered queries and the pipeline on the smallest data."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tagloom.llm import queries
from tests.llm import brute
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not there")


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] and len({n.split("_")[0] for n in queries.QUERIES}) == 13
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name).startswith("ok")


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        seen[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    before, after = map(rows, seen["toxicity"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = {d for d, _ in before} - {d for d, _ in after}
    assert {d for d, _ in before if labels.get(d) == 1} <= gone and not any(labels.get(d) == 0 for d in gone)

    before, after = map(rows, seen["near_copies"])
    assert sorted(d for d, _ in after) == sorted({c for _, _, c in brute.components(before)})

    before, after = map(rows, seen["repeats"])
    assert Counter(after) == Counter((d, k.decode(errors="ignore")) for d, _, k, _ in brute.removal(before, corpus_pipeline.REPEAT_BYTES))

    before, after = map(rows, seen["mixing"])
    copies = Counter(d for d, _ in after)
    assert max(copies.values()) == 2 and set(after) <= set(before)
    words = lambda rs: sum(len((t or "").split()) for _, t in rs)
    assert abs(words(after) / words(before) - 1.5) < 0.02

    pieces = seen["packing"][1].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and len(filled) <= 1.05 * sum(filled.values()) / 4096 + 1
