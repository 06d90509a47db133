"""Ordinal operators, merges, near duplicates and user functions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import batch, dictionary as dc, merge as mg, neardup as nd, ordinal as od, search as sr, sorting as so
from tagloom.streaming.edits import edit_stream, label_new_files


@pytest.fixture(scope="module")
def numbers(spark):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(f"k{v:04d}", v, v % 7) for v in values], "image_key string, ord bigint, grp bigint")
    return df.repartition(6)


def test_row_index_is_dense_and_ordered(numbers):
    rows = od.row_index(numbers, [F.col("grp").desc(), F.col("ord")]).collect()
    got = [r.image_key for r in sorted(rows, key=lambda r: r.row_index)]
    assert sorted(r.row_index for r in rows) == list(range(500))
    assert got == [f"k{v:04d}" for v in sorted(range(500), key=lambda v: (-(v % 7), v))]
    assert {r.total for r in rows} == {500}


def test_shuffled_index_is_a_permutation(numbers):
    rows = od.shuffled_index(numbers, seed=5, digits=1).collect()
    assert sorted(r.row_index for r in rows) == list(range(500))
    again = {r.image_key: r.row_index for r in od.shuffled_index(numbers.repartition(3), seed=5, digits=2).collect()}
    assert {r.image_key: r.row_index for r in rows} == again


def test_split_and_batches(numbers):
    index = od.row_index(numbers, ["ord"])
    parts = {r.part: r.n for r in od.split_by_ratio(index, [7, 2, 1]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {0: 350, 1: 100, 2: 50}
    assert od.split_in_n(index, 7).select("part").distinct().count() == 7
    assert od.batches(index, 64).select("batch_id").distinct().count() == 8


def test_deep_pages_and_large_samples(numbers, monkeypatch):
    shallow = [r.ord for r in od.page(numbers, ["ord"], 3, 40).collect()]
    small = [r.image_key for r in od.sample(numbers, 90, seed=2).collect()]
    monkeypatch.setattr(od, "TOP_N_LIMIT", 10)
    assert [r.ord for r in od.page(numbers, ["ord"], 3, 40).collect()] == shallow == list(range(120, 160))
    assert [r.image_key for r in od.sample(numbers, 90, seed=2).collect()] == small
    assert od.page(numbers, ["ord"], 99, 40).count() == 0


def test_sample_fewer_than_asked(numbers):
    assert od.sample(numbers, 50, condition=F.col("ord") < 5).count() == 5


def test_cap_with_existing(numbers, spark):
    existing = spark.createDataFrame([(0, 8), (1, 20)], "grp bigint, already_exist bigint")
    sizes = {r.grp: r.n for r in od.cap_per_group(numbers, "grp", ["ord"], 10, existing).groupBy("grp").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 2: 10, 3: 10, 4: 10, 5: 10, 6: 10}
    rows = {r.image_key for r in od.cap_per_group(numbers, "grp", ["ord"], 10).collect()}
    assert rows == {f"k{v:04d}" for v in range(70)}


def test_first_source_wins_and_cache(spark):
    schema = "image_key string, ord bigint, v string"
    a = spark.createDataFrame([("x", 2, "a2"), ("x", 1, "a1")], schema)
    b = spark.createDataFrame([("x", 0, "b"), ("y", 0, None)], schema)
    assert {(r.image_key, r.v) for r in mg.first_source_wins([a, b], "ord").collect()} == {("x", "a1"), ("y", None)}
    cached = mg.cache_override(b, spark.createDataFrame([("x", 9, None)], schema))
    assert {(r.image_key, r.ord, r.v) for r in cached.collect()} == {("x", 9, None), ("y", 0, None)}


def test_index_delta_of_deleted_record(spark, tagged):
    delta = mg.index_delta(tagged(["A b", "c"]), tagged().limit(0)).collect()
    assert {(r.tag, r.delta) for r in delta} == {("a_b", -1), ("c", -1)}


@pytest.mark.parametrize("hot", [1, 5, 10**6])
@pytest.mark.parametrize("bands", [3, 4, 5, 8])
def test_near_duplicates_against_brute_force(spark, hot, bands):
    rng = random.Random(11)
    hashes = []
    for i in range(60):
        h = rng.getrandbits(64) if i % 3 else (0xABCD << 48) | rng.getrandbits(20)  # a third shares its first band
        hashes.append(h)
        for flips in (2, 7, 8):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), flips)))
    hashes += [hashes[0]] * 40  # exact copies
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "vec_id bigint, h1 bigint, h2 bigint")
    near = lambda a, b: bin(a ^ b).count("1") <= 7
    distinct = sorted(set(hashes))
    pairs = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if near(a, b)}
    found = nd.hash_pairs(df.select("h1", "h2").distinct(), bands=bands, hot_bucket=hot).collect()
    assert {((r.a1 << 32) | r.a2, (r.b1 << 32) | r.b2) for r in found} == pairs
    assert len(found) == len(pairs)
    kept = [i for i, h in enumerate(hashes) if not any(near(h, hashes[j]) for j in range(i))]
    assert sorted(r.vec_id for r in nd.drop_near_duplicates(df, bands=bands, hot_bucket=hot).collect()) == kept


def test_inline_and_joined_dictionaries_agree(spark, tagged):
    tag_dict = spark.createDataFrame(
        [("artist", "x"), ("character", "y_(z)"), ("quality", "x"), ("style", "s")], "kind string, tag string"
    )
    df = tagged(["x", r"Y \(z\)", "s", "s"], None, [], ["copyright: q", "by x", "best quality"])
    results = []
    for limit in (100, 0):
        rows = dc.with_typed_tags(df, tag_dict, inline_limit=limit).select("image_key", "typed").collect()
        results.append({r.image_key: r.typed for r in rows})
    assert results[0] == results[1]
    assert [x.type for x in results[0]["k0"]] == ["artist", "character", "style", "style"]
    assert [x.type for x in results[0]["k3"]] == ["copyright", "artist", "quality"]

    table = spark.createDataFrame([("s", 5), ("x", 1)], "tag string, priority int")
    for reverse in (False, True):
        orders = []
        for limit in (100, 0):
            out = dc.with_table_priorities(df, table, [(0, "style", "style:.*")], inline_limit=limit)
            sorted_tags = dc.sort_by_priority(F.col("tags"), F.col("priorities"), reverse)
            orders.append({r.image_key: r.t for r in out.select("image_key", sorted_tags.alias("t")).collect()})
        assert orders[0] == orders[1]


def test_search_semantics(spark, tagged):
    df = tagged(["a b", "c"], ["c"], None).withColumn("terms", F.transform("tags", lambda t: F.replace(t, F.lit(" "), F.lit("_"))))
    keys = lambda **o: sorted(r.image_key for r in sr.by_tags(df, **o).collect())
    assert keys(include=["A B"]) == ["k0"]
    assert keys(include=["c"], exclude=["a b"]) == ["k1"]
    assert keys(include=[], exclude=["a b"]) == []
    assert keys(include=[], exclude=["a b"], joiner="or") == ["k1", "k2"]
    assert keys(include=["c", "zzz"], include_condition="all") == []
    assert keys(include=["A .*"], regex=True) == ["k0"]
    index = df.select("image_key", F.explode("terms").alias("tag"))
    searches = [
        dict(include=["A B"]), dict(include=["c"], exclude=["a b"]), dict(exclude=["a b"]), dict(exclude=["a b"], joiner="or"),
        dict(include=["c", "zzz"], include_condition="all"), dict(include=["A .*", "c"], include_condition="all", regex=True),
        dict(include=["a b"], exclude=["c", "a b"], exclude_condition="all", joiner="or"), dict(), dict(joiner="or"),
    ]
    for options in searches:
        assert sorted(r.image_key for r in sr.by_index(df, index, **options).collect()) == keys(**options), options


def test_sorting_nulls_and_ties(spark):
    rows = [("a", 0, None, 1, 2), ("b", 1, 3.0, 2, 1), ("c", 2, 3.0, 2, 0), ("d", 3, 9.5, None, None)]
    df = spark.createDataFrame(rows, "image_key string, ord bigint, aesthetic_score double, w int, h int").withColumn(
        "original_size", F.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("width"), F.col("h").alias("height")))
    ).withColumns({"image_path": F.lit("/x/y/z.png"), "tags": F.lit(None).cast("array<string>")})
    names = lambda *m, reverse=False: [r.image_key for r in so.sort_records(df, m, reverse).collect()]
    assert names("aesthetic_score") == ["a", "b", "c", "d"]
    assert names("aesthetic_score", reverse=True) == ["d", "b", "c", "a"]
    assert names("original_aspect_ratio") == ["c", "d", "a", "b"]
    assert names("quality_or_score") == ["b", "c", "a", "d"]
    with pytest.raises(KeyError):
        so.sort_key("nothing")


def test_user_functions_and_edits(tagged):
    df = tagged(["a"], None)
    upper = lambda frame: frame.assign(image_key=frame["image_key"].str.upper())
    assert sorted(r.image_key for r in batch.map_batches(df, upper).collect()) == ["K0", "K1"]
    assert batch.to_label(df).count() == 1
    assert batch.to_label(df, overwrite=True).count() == 2
    assert batch.to_label(df, labelled=df.filter("ord = 1")).count() == 0
    edited = batch.edit(df.withColumn("image_path", F.lit("/r/c/k.png")), "add_tags", where=F.col("ord") == 0, new=["%cat%"])
    assert {r.image_key: r.tags for r in edited.collect()} == {"k0": ["c", "a"], "k1": None}


def test_edits_run_on_a_stream(spark, tagged, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    tagged(["a b", "a b"], ["c"]).write.parquet(source)
    stream = spark.readStream.schema("image_key string, ord bigint, tags array<string>").parquet(source)
    edits = [("unique", {}), ("format", {"formats": ["underline"]})]
    for _ in range(2):  # the second run finds nothing new
        label_new_files(stream, lambda df: edit_stream(df, edits), out, str(tmp_path / "progress")).awaitTermination()
    assert {r.image_key: r.tags for r in spark.read.parquet(out).collect()} == {"k0": ["a_b"], "k1": ["c"]}
    assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("distance, bands", [(0, 2), (7, 3), (6, 3), (9, 4), (8, 4), (2, 5)])
def test_second_bands_radii_are_enough_and_tight(distance, bands):
    """Missing every band takes more bits than the distance, but only one more."""
    radii = nd._radii(distance, bands)
    assert len(radii) == bands and sum(r + 1 for r in radii) == distance + 1


def test_near_hashes_are_dealt_to_more_tasks(spark, monkeypatch):
    """Tasks grow with the rows of the bands; the result stays that of comparing all hashes."""
    rng = random.Random(5)
    points = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(6)]
    rows = [(i, a ^ rng.getrandbits(2), b ^ rng.getrandbits(2)) for i, (a, b) in enumerate(points * 6)]
    df = spark.createDataFrame(rows, "vec_id long, h1 long, h2 long")
    gap = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    kept = [x[0] for x in rows if not any(y[0] < x[0] and gap(x, y) <= 7 for y in rows)]
    distinct = sorted({x[1:] for x in rows})
    pairs = sorted((*a, *b, gap((0, *a), (0, *b))) for a in distinct for b in distinct if a < b and gap((0, *a), (0, *b)) <= 7)
    monkeypatch.setattr(nd, "TASK_ROWS", 150)
    assert nd._dealt(df, 1500, ["h1"]).rdd.getNumPartitions() == 10
    for hot in (3, 1000):
        assert sorted(r.vec_id for r in nd.drop_near_duplicates(df, hot_bucket=hot).collect()) == kept
        assert sorted(tuple(r) for r in nd.hash_pairs(df.select("h1", "h2").distinct(), hot_bucket=hot).collect()) == pairs
