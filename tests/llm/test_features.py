"""Passes over the labelled sample."""

import numpy as np

from tagloom.llm import features, toxicity


def test_passes_send_few_short_rows_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} word{i % 7} text {i}") for i in range(60)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    kind, seen = type(docs), []
    collect = kind.collect

    def counted(self):
        rows = collect(self)
        seen.append([len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))])
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    weights, _ = toxicity.model(docs, labels, 3, 1000)
    assert np.abs(weights).max() > 0 and len(seen) > 2
    assert max(max(x, default=0) for x in seen) <= 8 * features.SLICE
    assert max(sum(x) for x in seen[1:]) <= features.SUMS * 8 * (features.DIM + 4)


def test_feature_sums_add_up(spark):
    sample = spark.range(100).repartition(16)

    def add(total, batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                total[i % 7] += i
                total[-1] += 1

    total = features.feature_sums(sample, add, features.SLICE, 5)
    assert total[:7].tolist() == [sum(i for i in range(100) if i % 7 == k) for k in range(7)]
    assert total[-1] == 100 and total.sum() == 4950 + 100


def test_features_that_no_example_holds_take_no_room_in_a_pass(spark, monkeypatch):
    sample = spark.range(1000).repartition(16)
    kind, seen = type(sample), []
    collect = kind.collect

    def counted(self):
        rows = collect(self)
        seen.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    def add(total, batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                total[257 * i] += i / 3
                total[-1] += 1

    monkeypatch.setattr(kind, "collect", counted)
    total = features.feature_sums(sample, add, features.DIM, 1)
    assert total[-1] == 1000 and np.array_equal(np.flatnonzero(total[:-1]), 257 * np.arange(1, 1000))
    assert np.array_equal(total[: features.DIM : 257][:1000], (np.arange(1000) / 3).astype(np.float32))
    assert 0 < max(seen) < features.DIM / 4


def test_packed_numbers_come_back_bit_by_bit():
    for numbers in (np.zeros(0), np.array([0.0, -0.0, np.inf, -np.inf, 5e-324, 1 / 3]), np.random.default_rng(1).normal(size=features.SLICE)):
        back = features.unpacked(features.packed(numbers), len(numbers))
        assert back.tobytes() == numbers.tobytes()
