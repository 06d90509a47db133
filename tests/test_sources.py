"""Readers and sinks on real files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tagloom.functions import metadata as md, paths
from tagloom.operators.records import with_caption_attrs
from tagloom.plans import ordering
from tagloom.plans.tables import Tables
from tagloom.sources import readers as rd, writers as wr


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "set" / "cat a"
    base.mkdir(parents=True)
    (tmp_path / "set" / "deep").mkdir()
    for name in ("one.png", "two.jpg", "three.webp", "four.PNG", "five.jpeg", ".hidden.png"):
        (base / name).write_bytes(b"x")
    (tmp_path / "set" / "deep" / "six.png").write_bytes(b"x")
    (base / "one.txt").write_text("a, b，c, 日本", encoding="utf-8")
    (base / "two.txt").write_text("")
    payload = {
        "tag_string": "x_y artist_a char_b meta_c x_y", "tag_string_artist": "artist_a", "tag_string_character": "char_b",
        "tag_string_meta": "meta_c", "rating": "s", "image_width": 10, "image_height": 20,
    }
    (base / ".three_meta.json").write_text(json.dumps({"danbooru": payload}))
    (base / "five.jpeg.json").write_text(json.dumps({**payload, "rating": "q"}))
    (base / "two.jpg.json").write_text(json.dumps(payload))
    return tmp_path / "set"


def test_listing_in_the_tasks_equals_sparks(spark, folder):
    """Hidden and empty files, hidden folders, names with blanks; neither files nor folders go through the driver's file index."""
    for name in ("_skipped", ".git", "so so"):
        (folder / name).mkdir()
        (folder / name / f"in {name}.png").write_bytes(b"xy")
        (folder / name / f"in {name}.txt").write_bytes("é\r\n, z".encode())
    (folder / "empty.png").write_bytes(b"")
    (folder / "gone.png").symlink_to(folder / "nowhere.png")
    (folder / "_under.png").write_bytes(b"x")
    for recursive in (True, False):
        listed = rd.list_images(spark, str(folder), recursive, mount=rd.MOUNTED)
        assert sorted(listed.collect()) == sorted(rd.list_images(spark, str(folder), recursive).collect())
        assert "binaryFile" not in listed._jdf.queryExecution().executedPlan().toString()
    twice = [f"file:{folder}/deep", str(folder / "cat a")]
    assert sorted(rd.list_images(spark, twice, mount=rd.MOUNTED).collect()) == sorted(rd.list_images(spark, twice).collect())
    captions = rd.read_captions(spark, str(folder), rd.MOUNTED)
    assert "binaryFile" not in captions._jdf.queryExecution().executedPlan().toString()
    assert sorted(captions.collect()) == sorted(rd.read_captions(spark, str(folder)).collect())
    by_task, by_spark = (rd.read_folder(spark, str(folder), mount=m).collect() for m in (rd.MOUNTED, None))
    assert sorted(by_task, key=lambda r: r.image_path) == sorted(by_spark, key=lambda r: r.image_path)


def test_folder_scan_and_sidecars(spark, folder):
    rows = {r.image_key: r for r in rd.read_folder(spark, str(folder), fetch=rd.mounted_text).collect()}
    assert set(rows) >= {"one", "two", "three", "five", "six"} and "four" not in rows
    assert rows["one"].tags == ["a", "b,c", "日本"]
    assert rows["two"].tags is None  # an empty text sidecar still wins over metadata
    assert rows["three"].tags == ["x y", "artist: artist a", "character: char b"]
    assert rows["three"].safe_level == "s" and tuple(rows["three"].original_size) == (10, 20)
    assert rows["five"].safe_level == "q"
    assert rows["six"].tags is None
    listed = {r.image_key: r.tags for r in rd.read_folder(spark, str(folder)).collect()}
    assert listed["one"] == rows["one"].tags and listed["three"] is None
    flat = rd.list_images(spark, str(folder), recursive=False)
    assert flat.count() == 0
    only_meta = {r.image_key: r.tags for r in rd.read_folder(spark, str(folder), read_types=("danbooru",), fetch=rd.mounted_text).collect()}
    assert only_meta["one"] is None and only_meta["two"] == ["x y", "artist: artist a", "character: char b"]


def test_listing_does_not_read_contents(spark, folder):
    plan = rd.list_images(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_json_object_and_csv(spark, tmp_path):
    records = {
        "k1": {"image_path": "/a/b/k1.png", "caption": "x, y", "original_size": [3, 4], "aesthetic_score": 1.5, "artist": None, "extra": 1},
        "k2": {"image_path": "/a/b/k2.png", "caption": None},
    }
    (tmp_path / "db.json").write_text(json.dumps(records, indent=4))
    rows = {r.image_key: r for r in rd.read_record_json(spark, str(tmp_path / "db.json")).collect()}
    assert rows["k1"].caption == "x, y" and tuple(rows["k1"].original_size) == (3, 4) and rows["k1"].aesthetic_score == 1.5
    assert rows["k2"].caption is None and rows["k2"].original_size is None
    records["k3"] = {"image_path": "/a/b/k3.png", "caption": "a\n    },\n    b, \"c\""}
    for n, some in enumerate((records, {"k1": records["k1"]}, {})):
        (tmp_path / f"indented{n}.json").write_text(json.dumps(some, indent=4))
        path = str(tmp_path / f"indented{n}.json")
        split = sorted(rd.read_record_json(spark, path).collect(), key=str)
        assert split == sorted(rd.read_record_json(spark, path, indent=3).collect(), key=str) and len(split) == len(some)
    records["k4"] = {"image_path": "/a/b/k4.png", "aesthetic_score": "7.5", "safe_rating": "no number"}
    (tmp_path / "damaged.json").write_text(json.dumps(records, indent=4)[:-120])
    (tmp_path / "flat.json").write_text(json.dumps(records))
    both = [str(tmp_path / "damaged.json"), str(tmp_path / "flat.json")]
    assert {r.n for r in rd.damaged_parts(spark, both).collect()} == {1}
    flat = {r.image_key: r for r in rd.read_record_json(spark, both[1], damaged="fail").collect()}
    assert set(flat) == {"k1", "k2", "k3", "k4"} and flat["k4"].aesthetic_score == 7.5 and flat["k4"].safe_rating is None
    assert rd.read_record_json(spark, both[0]).count() == 3
    with pytest.raises(Exception, match="damaged JSON"):
        rd.read_record_json(spark, both[0], damaged="fail").collect()

    (tmp_path / "db.csv").write_text(
        'image_key,image_path,caption,original_size,aesthetic_score,unknown\nk1,/a/k1.png,"x, ""y""","(3, 4)",1.25,z\nk2,/a/k2.png,,,,\n'
    )
    rows = {r.image_key: r for r in rd.read_record_csv(spark, str(tmp_path / "db.csv")).collect()}
    assert rows["k1"].caption == 'x, "y"' and tuple(rows["k1"].original_size) == (3, 4) and rows["k1"].aesthetic_score == 1.25
    assert rows["k2"].caption is None and rows["k2"].aesthetic_score is None
    assert "unknown" not in rows["k1"].asDict()


def records_frame(spark):
    rows = [("k1", "/d/c/k1.png", ["x", 'q "r"'], 2.5), ("k2", "/d/c/k2.png", [], None), ("k3", "/d/c/k3.png", None, 1.0)]
    return spark.createDataFrame(rows, "image_key string, image_path string, tags array<string>, aesthetic_score double")


def test_round_trips_and_upsert(spark, tmp_path):
    df = records_frame(spark)
    lines, csv = str(tmp_path / "lines"), str(tmp_path / "csv")
    wr.write_json(df, lines)
    wr.write_csv(df, csv, sep=";")
    for back in (rd.read_record_lines(spark, lines), rd.read_record_csv(spark, csv, sep=";")):
        got = {r.image_key: (r.caption or None, r.aesthetic_score) for r in back.collect()}
        assert got == {"k1": ('x, q "r"', 2.5), "k2": (None, None), "k3": (None, 1.0)}
    merged = str(tmp_path / "merged")
    wr.write_json(df.filter("image_key = 'k1'").withColumn("aesthetic_score", F.lit(9.0)), merged, stored=rd.read_record_lines(spark, lines))
    assert {r.image_key: r.aesthetic_score for r in rd.read_record_lines(spark, merged).collect()} == {"k1": 9.0, "k2": None, "k3": 1.0}
    objects = rd.explode_record_json(wr.record_json(df))
    assert {r.image_key: r.caption for r in objects.collect()} == {"k1": 'x, q "r"', "k2": "", "k3": None}


def test_caption_files(spark, tmp_path):
    df = records_frame(spark).withColumn("image_path", F.concat(F.lit(str(tmp_path)), F.lit("/c/"), "image_key", F.lit(".png")))
    manifest = wr.write_captions(df, wr.mounted_text).collect()
    assert [(m.image_key, m.bytes, m.status) for m in manifest] == [("k1", 8, "written")]
    assert (tmp_path / "c" / "k1.txt").read_text() == 'x, q "r"'
    assert not (tmp_path / "c" / "k2.txt").exists()
    found = {r.label_path: r.caption for r in rd.read_captions(spark, str(tmp_path)).collect()}
    assert found == {str(tmp_path / "c" / "k1.txt"): 'x, q "r"'}


def test_statistic_shapes(spark):
    texts = ['{"c1": {"t1": 3, "t2": 1}}', '{"c2": {"t1": 0.5, "t2": 1}}', '{"c3": ["t1", "t2"]}', '{"c4": {"t1": [5, 0.5]}}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = {(r.character, r.tag, r.cnt, r.freq) for r in rd.statistic_rows(df).collect()}
    assert rows == {("c1", "t1", 3, None), ("c1", "t2", 1, None), ("c2", "t1", None, 0.5), ("c2", "t2", None, 1.0), ("c4", "t1", 5, 0.5), ("c3", "t1", None, None), ("c3", "t2", None, None)}


def test_feature_table_from_files(spark, tmp_path):
    tables = {
        "counts": {"Some_Girl": {"Some girl": 60, "red hair": 40, "long_hair": 5, "hat": 50}, "rare": {"rare": 3, "red hair": 3}},
        "freqs": {"other": {"blue hair": 0.5, "red hair": 0.1}},
        "pairs": {"third": {"pink hair": [9, 0.9], "grey hair": [0, 0.9]}},
        "lists": {"fourth": ["anything"]},
    }
    for name, body in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=4))
    found = rd.feature_table(rd.read_statistics(spark, str(tmp_path)), [".* hair"])
    assert {tuple(r) for r in found.collect()} == {("some girl", "red hair"), ("other", "blue hair"), ("third", "pink hair"), ("fourth", "anything")}


def test_csv_keeps_line_breaks_in_cells(spark, tmp_path):
    captions = {"k1": 'one\ntwo, "three"', "k2": "a\r\nb", "k3": "c\rd", "k4": "plain"}
    df = spark.createDataFrame([(k, f"/d/{k}.png\nx", [c]) for k, c in captions.items()], "image_key string, image_path string, tags array<string>")
    wr.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = rd.read_record_csv(spark, str(tmp_path / "out")).collect()
    assert {r.image_key: (r.caption, r.image_path) for r in back} == {k: (c, f"/d/{k}.png\nx") for k, c in captions.items()} and len(back) == 4
    path = str(tmp_path / "db.csv")
    (tmp_path / "db.csv").write_text('image_key,image_path,caption\nk1,/a/k1.png,"x,\ny"\nk2,/a/k2.png,z\n')
    assert {r.image_key: r.tags for r in rd.load_paths(spark, [path]).collect()} == {"k1": ["x,\ny"], "k2": ["z"]}
    assert rd.load_paths(spark, [path], options={path: {"multi_line": False}}).count() == 3


def test_sources_by_path(spark, folder):
    (folder / "db.json").write_text(json.dumps({"one": {"image_path": "/z/one.png", "caption": "from json"}, "new": {"image_path": "/z/new.png"}}))
    (folder / "db.csv").write_text("image_key,image_path,caption\nnew,/y/new.png,from csv\nnew,/x/new.png,again\nlast,/y/last.png,\n")
    image = str(folder / "cat a" / "one.png")
    got = {r.image_key: r for r in rd.load_paths(spark, [image, str(folder / "db.json"), str(folder / "db.csv")], fetch=rd.mounted_text).collect()}
    assert set(got) == {"one", "new", "last"}
    assert got["one"].tags == ["a", "b,c", "日本"] and got["new"].image_path == "/z/new.png"
    alone = rd.load_paths(spark, [str(folder / "db.csv")], key_condition=F.col("image_key") == "new").collect()
    assert [(r.image_key, r.image_path) for r in alone] == [("new", "/x/new.png")]


def test_other_file_systems_are_refused():
    with pytest.raises(ValueError, match="no mounted path"):
        rd.mounted_text("s3a://bucket/x.txt")
    with pytest.raises(ValueError, match="no mounted path"):
        wr.mounted_text("hdfs://host/x.txt", "x")


def test_paths(spark):
    values = ["/a/b/c/x.tar.gz", "/a/b/c/noext", "/a/b/c/.hidden", "/a/b/c/x."]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    p = F.col("p")
    rows = df.select(paths.stem(p), paths.suffix(p), paths.category(p), paths.source(p), paths.root(p), paths.label_path(p)).collect()
    assert [r[0] for r in rows] == ["x.tar", "noext", ".hidden", "x."]
    assert [r[1] for r in rows] == [".gz", "", "", ""]
    assert {(r[2], r[3], r[4]) for r in rows} == {("c", "/a/b", "/a")}
    assert [r[5] for r in rows][:2] == ["/a/b/c/x.tar.txt", "/a/b/c/noext.txt"]


def test_generation_parameters(spark):
    metas = [
        {"parameters": "a cat, Negative prompt: dog Steps: 20, Sampler: Euler, Steps: 30, Size: 1x2"},
        {"parameters": "a cat Steps: 20"},
        {"Title": "t", "Comment": '{"prompt": "p", "uc": "n", "SEED": 5}', "Software": "s"},
        {"other": "x"},
        {},
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "i int, m map<string,string>")
    got = {r.i: r.g for r in df.select("i", md.gen_info(F.col("m")).alias("g")).collect()}
    assert got[0] == {"Positive prompt": "a cat, ", "Negative prompt": "dog ", "Steps": "30", "Sampler": "Euler", "Size": "1x2"}
    assert got[1] == {"Positive prompt": "a cat ", "Negative prompt": "", "Steps": "20"}
    assert got[2] == {"Title": "t", "Software": "s", "Positive prompt": "p", "Negative prompt": "n", "Seed": "5"}
    assert got[3] == {} and got[4] == {}


def test_base36(spark):
    values = [0, 35, 36, 123456789, -37]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    rows = df.select(md.to_base36(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == ["0", "z", "10", "21i3v9", "-11"]
    assert [int(r.t, 36) for r in rows] == values


def test_caption_attributes(spark):
    from tagloom.functions import derived as dv

    df = records_frame(spark).withColumn("typed", dv.typed(F.col("tags"), {}))
    row = with_caption_attrs(df).filter("image_key = 'k1'").first()
    assert row.artist is None and row.quality is None and row.characters is None and row.styles is None


def test_written_files_are_read_in_parts_and_go(spark, tmp_path, monkeypatch):
    """No more files lie on disk than a part has, and none afterwards; repeated records stay in one part."""
    rows = [(i, f"img{i}", f"/data/{i % 3}/img{i}.png", "gs"[i % 2], ["a", f"t{i}"]) for i in (*range(20), 3, 5)]
    t = Tables(spark, "nowhere")
    t.__dict__["records"] = spark.createDataFrame(rows, "ord bigint, image_key string, image_path string, safe_level string, tags array<string>")
    monkeypatch.setattr(ordering, "FILES", 11)
    monkeypatch.setattr(ordering, "folder", lambda t, purpose: str(tmp_path / f"{purpose}-{uuid.uuid4().hex}"))
    seen, remove = [], wr.remove_texts

    def counted(manifest, how):
        seen.append(sum(p.is_file() for p in tmp_path.rglob("*")))
        return remove(manifest, how)

    monkeypatch.setattr(wr, "remove_texts", counted)
    suffixes = (".png", ".jpg", ".webp", ".txt")
    listed = sorted(tuple(r) for r in ordering.listed_images(t).collect())
    assert listed == sorted((f"img{i}", f"/data/{i % 3}/img{i}{suffixes[i % 4]}", 1) for i in range(20) if i % 4 < 3)
    labelled = sorted((r.image_key, r.tags) for r in ordering.labelled(t).collect())
    assert labelled == sorted((k, tags if level == "s" else None) for _, k, _, level, tags in rows)
    assert len(seen) == 4 and max(seen) < 20 and sum(seen) == 30
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_removal_refuses_paths_with_a_scheme():
    with pytest.raises(ValueError):
        wr.mounted_removal("s3a://bucket/x.txt")


def test_spare_files_become_the_new_ones(spark, tmp_path):
    """No file is made while there are spare ones, none of these is left, and what is written is as without them."""
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir()
    for i in range(40):
        (old / f"f{i}").write_text("a longer text than before" if i % 2 else "")
    (new / "a").mkdir(parents=True)
    (new / "a" / "2.txt").write_text("there already, and longer")
    inodes = {p.stat().st_ino for p in old.iterdir()}
    spares = wr.Spares(spark.createDataFrame([(str(old / f"f{i}"),) for i in (*range(40), 3, 77)], "path string"), wr.mounted_reuse, wr.mounted_removal)
    texts = [(str(new / "ab"[i % 2] / f"{i}.txt"), "" if i == 4 else f"é{i}") for i in range(20)]
    manifest = wr.write_texts(spark.createDataFrame(texts, "path string, text string"), wr.mounted_text, spares).collect()
    assert sorted(tuple(r) for r in manifest) == sorted((p, len(t.encode())) for p, t in texts)
    found = {str(p): p for p in new.rglob("*") if p.is_file()}
    assert {k: p.read_text() for k, p in found.items()} == dict(texts) and not list(old.iterdir())
    assert sum(p.stat().st_ino in inodes for p in found.values()) >= 10 and all(p.stat().st_nlink == 1 for p in found.values())
    df = spark.createDataFrame([("k1", str(new / "c" / "1.png"), ["x", "y"]), ("k2", str(new / "c" / "2.png"), [])], "image_key string, image_path string, tags array<string>")
    spares = spares._replace(files=spark.createDataFrame([(k,) for k in found], "path string"))
    assert [tuple(r) for r in wr.write_captions(df, wr.mounted_text, spares).collect()] == [("k1", str(new / "c" / "1.txt"), 4, "written")]
    assert [p.read_text() for p in new.rglob("*") if p.is_file()] == ["x, y"]


@pytest.mark.parametrize(("small", "near", "rounds"), [(1000, 100, 1), (1, 100, None), (1000, 2, None)])
def test_small_folders_are_listed_where_they_are_found(spark, tmp_path, monkeypatch, small, near, rounds):
    for i in range(12):
        (tmp_path / f"{i % 3}" / f"{i}").mkdir(parents=True)
        for j in range(i % 4):
            (tmp_path / f"{i % 3}" / f"{i}" / f"{j}.png").write_bytes(b"x")
    seen, materialise = [], rd.materialise
    monkeypatch.setattr(rd, "SMALL", small)
    monkeypatch.setattr(rd, "NEAR", near)
    monkeypatch.setattr(rd, "materialise", lambda df, purpose: seen.append(purpose) or materialise(df, purpose))
    listed = sorted(rd.list_images(spark, str(tmp_path), mount=rd.MOUNTED).collect())
    assert listed == sorted(rd.list_images(spark, str(tmp_path)).collect()) and len(listed) == 18
    assert rounds in (None, len(seen))
    assert rd.list_images(spark, str(tmp_path), False, mount=rd.MOUNTED).count() == 0
