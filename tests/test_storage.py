"""Stored datasets: splitting text cells, index runs, partial saves, labelling that resumes, pages, hash tables."""

import csv
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.operators import batch, dictionary as dc, hash_index as hi, lookup as lk, merge as mg, neardup as nd, ordinal as od, vocabulary as vc
from tagloom.sources import index_runs, pages, quoted, readers as rd, saves, versions
from tagloom.streaming import labelling


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# -- separated values -------------------------------------------------------------------------------------


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_with_line_breaks_in_many_splits(spark, tmp_path, end):
    rng = random.Random(1)
    cells = ["", 'a "b" c', "two\nlines", "\n\n", '"', "x\r\ny", "é,漢\n" * 30, "plain", "long\n" * 200]
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(["image_key", "caption", "description"])
            writer.writerows([f"{name}{i}", rng.choice(cells), rng.choice(["1", "", "z\nz"])] for i in range(60))
    want = rows_of(spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert rows_of(quoted.read_csv(spark, str(tmp_path))) == want
            if size != "128m":
                assert quoted.read_records(spark, str(tmp_path)).select("file", "start").distinct().count() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rd.read_record_csv(spark, str(tmp_path)).count() == 120


def test_open_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('image_key,caption\nk1,"never closed\nk2,x\n')
    assert [r.text for r in quoted.read_records(spark, str(tmp_path / "open.csv")).orderBy("start", "at").collect()] == ["image_key,caption", 'k1,"never closed\nk2,x']
    (tmp_path / "head.csv").write_text("image_key,caption\n\n")
    assert quoted.read_csv(spark, str(tmp_path / "head.csv")).count() == 0


# -- versions ---------------------------------------------------------------------------------------------


def test_versions_appear_once(spark, tmp_path):
    path = str(tmp_path)
    assert versions.current(spark, path) == (0, {})
    versions.commit(spark, path, 1, {"a": "é", "folders": []})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 1, {"a": 2})
    versions.commit(spark, path, 2, {"a": 3, "folders": []})
    assert versions.current(spark, path) == (2, {"a": 3, "folders": []}) and versions.current(spark, path, 1)[1]["a"] == "é"
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path, 7)


# -- index runs -------------------------------------------------------------------------------------------


def test_index_runs_equal_an_index_built_afresh(spark, tmp_path):
    rng, path, at = random.Random(2), str(tmp_path / "index"), {}
    frame = lambda records: spark.createDataFrame([(k, v) for k, v in records.items()], "image_key string, tags array<string>")
    forms = lambda records: Counter((t, k) for k, v in records.items() for t in set(v or []))
    states = [at := {k: v for k, v in {**at, **{f"k{rng.randint(0, 30)}": rng.choice([None, [], rng.choices("abcdef", k=3)]) for _ in range(12)}}.items() if rng.random() < 0.9} for _ in range(4)]
    index_runs.create(mg.index_delta(frame({}), frame(states[0])).select("tag", "image_key"), path)
    for before, after in zip(states, states[1:]):
        index_runs.add_run(path, mg.index_delta(frame(before), frame(after)))
        assert rows_of(index_runs.load(spark, path)) == forms(after)
    wanted = index_runs.load(spark, path).filter("tag = 'c'")
    assert rows_of(wanted) == Counter({p: 1 for p in forms(states[-1]) if p[0] == "c"})
    scans = re.findall(r"PushedFilters: \[([^\]]*)\]", wanted._jdf.queryExecution().toString())
    assert len(scans) >= 4 and all("EqualTo(tag,c)" in s for s in scans)
    assert index_runs.compact(spark, path, whole=False) == 5 and len(versions.current(spark, path)[1]["runs"]) == 1
    assert rows_of(index_runs.load(spark, path)) == forms(states[-1])
    index_runs.compact(spark, path)
    assert not versions.current(spark, path)[1]["runs"] and rows_of(index_runs.load(spark, path)) == forms(states[-1])
    assert rows_of(index_runs.load(spark, path, 1)) == forms(states[0])
    index_runs.forget(spark, path)
    assert len(versions.names(spark, f"{path}/runs")) == 1 and rows_of(index_runs.load(spark, path)) == forms(states[-1])


def test_edits_that_cancel_out(spark, tmp_path):
    path = str(tmp_path / "index")
    index_runs.create(spark.createDataFrame([("a", "k1")], "tag string, image_key string"), path)
    index_runs.add_run(path, spark.createDataFrame([("a", "k1", -1), ("a", "k1", 1), ("b", "k1", 1), ("b", "k2", -1)], "tag string, image_key string, delta int"))
    assert rows_of(index_runs.load(spark, path)) == Counter({("a", "k1"): 1, ("b", "k1"): 1})


def test_index_is_merged_in_one_pass(spark, tmp_path, monkeypatch):
    """Base and runs are scanned once and meet in one aggregate; pairs without tag or key equal none, also after a compaction."""
    path, schema = str(tmp_path / "index"), "tag string, image_key string, delta int"
    index_runs.create(spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2"), (None, "k1"), ("a", None)], "tag string, image_key string"), path)
    index_runs.add_run(path, spark.createDataFrame([("a", "k1", -1), ("b", "k1", 1), ("d", "k3", 1), (None, "k1", 1), ("a", None, -1), (None, "k2", 1)], schema))
    index_runs.add_run(path, spark.createDataFrame([("d", "k3", -1), ("a", "k1", 1), ("a", None, 1), (None, "k2", -1)], schema))
    wanted = Counter({("a", "k1"): 1, ("b", "k1"): 1, ("c", "k2"): 1, (None, "k1"): 2, ("a", None): 2})
    loaded = index_runs.load(spark, path)
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 3 and plan.count("Exchange") == 1
    assert rows_of(loaded) == wanted
    plans, write = [], index_runs._sorted_write
    monkeypatch.setattr(index_runs, "_sorted_write", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *rest))
    index_runs.compact(spark, path, whole=False)
    assert rows_of(index_runs.load(spark, path)) == wanted
    index_runs.compact(spark, path)
    assert rows_of(index_runs.load(spark, path)) == wanted
    assert [p.count("Exchange") for p in plans] == [1, 1] and all("rangepartitioning" in p for p in plans)
    index_runs.add_run(path, spark.createDataFrame([("c", "k2", -1), (None, "k1", -1)], schema))
    assert rows_of(index_runs.load(spark, path)) == wanted - Counter([("c", "k2")])


# -- partial saves ----------------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "saved")
    saves.create(spark.range(1000).select(F.format_string("k%04d", "id").alias("image_key"), F.lit("old").alias("caption")).repartition(3), path, files=6)
    return path


def changes(spark, *rows):
    return spark.createDataFrame(rows, "image_key string, caption string, op string")


def test_save_rewrites_only_files_with_changed_keys(spark, stored, tmp_path):
    files = lambda: {(f["folder"], f["name"]) for f in saves.file_table(spark, stored).collect()}
    content = lambda names: {n: (tmp_path / "saved" / "data" / n[0] / n[1]).read_bytes() for n in names}
    first = files()
    old, before = content(first), {r.image_key: r.caption for r in saves.load(spark, stored).collect()}
    assert len(first) > 2
    number = saves.save(spark, stored, changes(spark, ("k0001", "new", "U"), ("k0000x", "added", "U"), ("k0002", None, "D"), ("nowhere", None, "D")))
    expected = {**before, "k0001": "new", "k0000x": "added"}
    del expected["k0002"]
    now = {r.image_key: r.caption for r in saves.load(spark, stored).collect()}
    assert number == 2 and now == expected
    kept = first & files()
    assert 0 < len(kept) < len(first) and content(kept) == {n: old[n] for n in kept}
    assert {r.image_key: r.caption for r in saves.load(spark, stored, 1).collect()} == before
    assert saves.save(spark, stored, changes(spark)) == 2
    saves.forget(spark, stored)
    assert {r.image_key: r.caption for r in saves.load(spark, stored).collect()} == expected and versions.versions(spark, stored) == [2]
    table = sorted(saves.file_table(spark, stored).collect(), key=lambda f: f["low"])
    assert all(a["high"] < b["low"] for a, b in zip(table, table[1:]))


def test_aborted_and_overtaken_saves(spark, stored, monkeypatch):
    before = rows_of(saves.load(spark, stored))
    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            saves.save(spark, stored, changes(spark, ("k0500", "lost", "U")))
    assert rows_of(saves.load(spark, stored)) == before
    current = versions.current(spark, stored)
    saves.save(spark, stored, changes(spark, ("k0500", "first", "U")))
    with monkeypatch.context() as patch:
        patch.setattr(versions, "current", lambda *a: current)
        with pytest.raises(versions.Conflict):
            saves.save(spark, stored, changes(spark, ("k0500", "second", "U")))
    assert saves.load(spark, stored).filter("image_key = 'k0500'").first().caption == "first"
    with pytest.raises(Exception, match="no key"):
        saves.save(spark, stored, changes(spark, (None, "x", "U")))


def test_everything_deleted_and_added_again(spark, stored):
    gone = saves.load(spark, stored).withColumn("op", F.lit("D"))
    saves.save(spark, stored, gone)
    assert saves.load(spark, stored).count() == 0
    saves.save(spark, stored, changes(spark, ("b", "x", "U"), ("a", "y", "U")))
    assert rows_of(saves.load(spark, stored)) == Counter({("b", "x"): 1, ("a", "y"): 1})


# -- labelling --------------------------------------------------------------------------------------------


def test_labelling_resumes_and_repeats_nothing(spark, tmp_path):
    source, output, progress = (str(tmp_path / x) for x in ("source", "output", "progress"))
    spark.range(200).select(F.concat(F.lit("k"), "id").alias("image_key")).repartition(10).write.parquet(source)
    schema, out = spark.read.parquet(source).schema, "image_key string, caption string"
    label = lambda df: batch.run_model(df, lambda: lambda frame: frame.assign(caption="seen " + frame["image_key"]), out)
    run = lambda model=label, most=None: labelling.label_files(spark, source, schema, model, output, progress, files_per_save=3, most_saves=most)
    assert run(most=1) == 1 and 0 < labelling.labelled(spark, output, out).count() < 200

    def broken(df):
        return batch.run_model(df, lambda: lambda frame: 1 / 0, out)

    with pytest.raises(Exception, match="ZeroDivisionError"):
        run(broken)
    assert len(labelling.committed(spark, output)) == 1
    # The job dies after its commit and before the stream notes it: the batch comes again and writes nothing.
    first = labelling.committed(spark, output)
    assert not labelling.save_batch(spark.read.parquet(source), 0, output, label) and labelling.committed(spark, output) == first
    assert run() == 3 and run() == 0
    assert rows_of(labelling.labelled(spark, output, out)) == Counter({(f"k{i}", f"seen k{i}"): 1 for i in range(200)})
    spark.createDataFrame([("late",)], "image_key string").write.mode("append").parquet(source)
    assert run() == 1 and labelling.labelled(spark, output, out).filter("image_key = 'late'").count() == 1


# -- vocabulary -------------------------------------------------------------------------------------------

PATTERN = st.text("ab_c(|)[]^.*+?{2}\\d- -", max_size=12)


@settings(max_examples=800, deadline=None)
@given(PATTERN, st.text("abc_-2 ", max_size=10))
def test_required_runs_are_in_every_match(pattern, text):
    try:
        compiled = re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError):
        return
    if compiled.match(text):
        assert all(r in text.lower() for r in vc.required_runs(pattern))


def test_vocabulary_search(spark):
    tags = {"k1": ["red_ring", "old_bolt"], "k2": ["Red_Rose", "x"], "k3": ["rose_red", "ſred_ring"], "k4": ["éred", "K2"], "k5": []}
    index = spark.createDataFrame([(t, k) for k, ts in tags.items() for t in ts] + [(None, "k5")], "tag string, image_key string")
    df = spark.createDataFrame([(k,) for k in tags], "image_key string")
    words = vc.vocabulary(index)
    postings = vc.gram_postings(words)
    find = lambda **o: {r[0] for r in vc.by_vocabulary(df, index, words, postings, **o).collect()}
    for listed in (0, 1000):
        assert find(include=["red.ro"], listed=listed) == {"k2"} and find(include=["red r(ing|ose)"], listed=listed) == {"k1", "k2"}
        assert find(include=["sred"], listed=listed) == {"k3"}  # a long s is an s without regard to case
        assert find(include=["k2"], listed=listed) == {"k4"}  # the Kelvin sign is a k
        assert find(exclude=["old bolt"], joiner="or", listed=listed) == {"k2", "k3", "k4", "k5"}
        assert find(include=["r.*", ".*bolt"], include_condition="all", listed=listed) == {"k1"}
    assert vc.candidates(words, postings, "red ring").count() < words.count()
    assert find() == set() and find(joiner="or") == set(tags)


# -- pages ------------------------------------------------------------------------------------------------


def test_pages_read_only_their_files(spark, tmp_path):
    path = str(tmp_path / "order")
    df = spark.range(1003).select(F.concat(F.lit("k"), "id").alias("image_key"), (F.col("id") * 7 % 1003).alias("ord"), F.create_map(F.lit("a"), F.lit("b")).alias("gen_info"))
    files = pages.write_order(df, [F.col("ord").desc()], path, files=7)
    assert files > 2 and pages.total(spark, path) == 1003
    for index in (0, 3, 6, 10, 11):
        page = pages.read_page(spark, path, index, 100)
        want = [r.image_key for r in od.page(df, [F.col("ord").desc()], index, 100).collect()]
        assert [r.image_key for r in page.collect()] == want
        assert len(page.inputFiles()) <= 2 if want else page.count() == 0
    assert pages.read_page(spark, path, -1, 10).count() == 0 and pages.read_page(spark, path, 0, 5000).count() == 1003
    pages.write_order(df.limit(0), ["ord"], path)
    assert pages.total(spark, path) == 0 and pages.read_page(spark, path, 0, 10).count() == 0


# -- hashes -----------------------------------------------------------------------------------------------


def test_nearest_of_each_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hi, "SCANNED", 64)
    rng, path = random.Random(3), str(tmp_path / "hashes")
    base = [rng.getrandbits(64) for _ in range(100)]
    rows = []
    for i in range(600):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        rows.append((i * 3 % 601, x >> 32, x & 0xFFFFFFFF))
    rows += [(5000 + i, *rows[0][1:]) for i in range(30)] + [(9000, None, 3), (9001, None, None)]
    targets = [(i, rows[i][1], rows[i][2] ^ rng.choice([0, 1, 9])) for i in range(60)] + [(1000 + i, rng.getrandbits(32), rng.getrandbits(32)) for i in range(80)] + [(2000, None, 1)]
    hi.write_hash_index(spark.createDataFrame(rows, "vec_id long, h1 long, h2 long"), path, most=9, bucket=10)
    asked = spark.createDataFrame(targets, "target long, t1 long, t2 long")
    for k, radius in ((1, 2), (9, 1)):
        want = Counter()
        for t, a, b in targets:
            if a is not None:
                near = sorted(((h1 ^ a).bit_count() + (h2 ^ b).bit_count(), v) for v, h1, h2 in rows if h1 is not None)[:k]
                want.update((t, rank, v, d) for rank, (d, v) in enumerate(near, 1))
        assert rows_of(hi.nearest_of_each(spark, path, asked, k, radius=radius)) == want


def test_nearest_with_few_records(spark, tmp_path):
    path = str(tmp_path / "few")
    hi.write_hash_index(spark.createDataFrame([(1, 0, 0), (2, 0, 3)], "vec_id long, h1 long, h2 long"), path)
    got = hi.nearest_of_each(spark, path, spark.createDataFrame([("a", 0, 1)], "target string, t1 long, t2 long"), 5)
    assert rows_of(got) == Counter({("a", 1, 1, 1): 1, ("a", 2, 2, 1): 1})


# -- odd keys ---------------------------------------------------------------------------------------------


def test_records_without_or_with_repeated_keys_stay(spark):
    posts = spark.createDataFrame([(1, [1, 2]), (1, [2]), (None, [1]), (None, None)], "id long, tag_ids array<long>")
    dimension = spark.createDataFrame([(1, "a", "artist"), (2, "b", "general")], "id long, name string, type string")
    assert sorted((r.id or 0, r.tags, r.tags_artist) for r in lk.post_tags(posts, dimension).collect()) == [(0, [], []), (0, ["a"], ["a"]), (1, ["a", "b"], ["a"]), (1, ["b"], [])]
    records = spark.createDataFrame([(None, ["c"], ["red", "x"]), (None, ["c"], ["blue"]), ("k", [], ["red"]), ("k", ["c", "c"], ["red"]), ("n", None, None)], "image_key string, characters array<string>, tags array<string>")
    features = spark.createDataFrame([("c", "red"), ("c", "blue"), (None, "x"), ("c", None)], "character string, feature string")
    for limit in (0, 100):
        got = sorted(((r.image_key or "", r.tags) for r in dc.defeature(records, features, inline_limit=limit).collect()), key=str)
        assert got == sorted([("", ["x"]), ("", []), ("k", ["red"]), ("k", []), ("n", None)], key=str)
    hashes = spark.createDataFrame([(1, 5, 5), (2, None, 5), (3, None, 5), (4, 5, 5), (None, 5, 5)], "vec_id long, h1 long, h2 long")
    assert sorted((r.vec_id or 0) for r in nd.drop_near_duplicates(hashes).collect()) == [0, 1, 2, 3]
    keyless = spark.createDataFrame([("a", "/1"), (None, "/2"), (None, "/3")], "image_key string, image_path string")
    merged = mg.first_source_wins([keyless, keyless.withColumn("image_path", F.concat("image_path", F.lit("x")))])
    assert sorted(r.image_path for r in merged.collect()) == ["/1", "/2", "/2x", "/3", "/3x"]
