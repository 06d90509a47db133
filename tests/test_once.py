"""How often records are derived: large sources must not be read again for every step."""

import pytest

from tagloom.operators import dictionary as dc
from tagloom.plans import catalog, storage
from tagloom.plans.tables import Tables

SCHEMA = "image_key string, tags array<string>, characters array<string>"


@pytest.fixture
def counted(spark):
    """Records whose rows are counted each time that they are derived."""

    def make(rows):
        seen = spark.sparkContext.accumulator(0)

        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return spark.createDataFrame(rows, SCHEMA).mapInPandas(count, SCHEMA), seen

    return make


ROWS = [("k0", ["a", "b"], ["x"]), ("k1", ["b", "b", "c"], []), ("k2", None, None), ("k2", ["a"], ["y"]), (None, ["c"], ["x"])]


def test_joined_types_derive_records_twice(spark, counted):
    df, seen = counted(ROWS)
    found = dc.with_typed_tags(df, spark.createDataFrame([("artist", "a")], "kind string, tag string"), inline_limit=0).select("image_key", "typed").collect()
    assert [x.type for r in found if r.image_key == "k0" for x in r.typed][:1] == ["artist"]
    assert seen.value <= 2 * len(ROWS)


def test_joined_overlap_derives_records_twice(spark, counted):
    df, seen = counted(ROWS)
    overlap = spark.createDataFrame([("a", [], ["b"])], "query string, parents array<string>, children array<string>")
    found = {(r.image_key, tuple(r.tags or ())) for r in dc.deoverlap(df, overlap, inline_limit=0).select("image_key", "tags").collect()}
    assert ("k0", ("a",)) in found and ("k1", ("b", "b", "c")) in found
    assert seen.value <= 2 * len(ROWS)


def test_feature_removal_derives_records_once(spark, counted, monkeypatch):
    df, seen = counted(ROWS)
    monkeypatch.setattr(Tables, "full", property(lambda self: df))
    assert len(catalog.QUERIES["j08_remove_character_features"](spark, "/root/testdata/sf0.001").collect()) == len(ROWS)
    assert seen.value == len(ROWS)


def test_edited_index_derives_records_once(spark, counted):
    t = Tables(spark, "/root/testdata/sf0.001")
    (first, seen1), (second, seen2) = counted(ROWS[:2]), counted(ROWS[1:2])
    t.__dict__.update(slim=first, other=second)
    found = storage.index_runs.load(spark, storage.edited_index(t)).collect()
    assert sorted(tuple(r) for r in found) == [("a", "k0"), ("b", "k0"), ("b", "k1"), ("c", "k1")]
    assert (seen1.value, seen2.value) == (2, 1)


@pytest.mark.parametrize("name", ["f03_tags_regex_by_index", "f03_tags_regex_by_vocabulary"])
def test_stored_index_derives_records_once(spark, counted, monkeypatch, name):
    df, seen = counted([("k0", ["red ring", "old bolt"], []), ("k1", ["red ring", "new bolt", "best ring"], []), ("k2", ["old bolt"], []), ("k3", None, None)])
    monkeypatch.setattr(Tables, "slim", property(lambda self: df))
    monkeypatch.setattr(Tables, "records", property(lambda self: df))
    assert [r.image_key for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()] == ["k0"]
    assert seen.value == 4
