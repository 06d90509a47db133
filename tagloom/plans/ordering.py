"""Queries of pages, splits, samples, sorts, near duplicates and file round trips."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, tags as tg
from ..operators import neardup as nd, ordinal as od, sorting as so
from ..runtime import materialise, scratch_path
from ..sources import readers as rd, writers as wr
from . import sqltext as q
from .recordset import META_SQL, VIEW, booru, dumped
from .registry import query
from .tables import Tables

# -- pages, splits, batches ---------------------------------------------------------------------------------------

BY_KEY = "SELECT image_key, row_number() OVER (ORDER BY ord) - 1 AS rn, count(*) OVER () AS n FROM records"
SHUFFLED = "SELECT image_key, row_number() OVER (ORDER BY md5('7:' || image_key), image_key) - 1 AS rn, count(*) OVER () AS n FROM records"


def in_order(t: Tables) -> DataFrame:
    return od.row_index(t.records, [F.col("ord")])


def shuffled(t: Tables) -> DataFrame:
    return od.shuffled_index(t.records, seed=7)


query("w01_page", "SELECT image_key, ord FROM records ORDER BY ord LIMIT 80 OFFSET 160")(
    lambda t: od.page(t.records, [F.col("ord")], 2, 80).select("image_key", "ord")
)
query("w01_page_out_of_range", "SELECT image_key, ord FROM records WHERE false")(
    lambda t: od.page(t.records, [F.col("ord")], 10**6, 80, merged=0).select("image_key", "ord")
)
def placed(df: DataFrame) -> DataFrame:
    """Rows with their place in the result's own order."""
    numbered = df.select("image_key").coalesce(1).withColumn("place", F.monotonically_increasing_id())
    return numbered.select("image_key", "place")


for name, limit in (("w01_page_places", None), ("w01_deep_page_places", 0)):
    query(name, "SELECT image_key, row_number() OVER (ORDER BY ord) - 1 AS place FROM (SELECT image_key, ord FROM records ORDER BY ord LIMIT 80 OFFSET 400)")(
        lambda t, limit=limit: placed(od.page(t.records, [F.col("ord")], 5, 80, merged=limit))
    )
for name, limit in (("w05_sample_places", None), ("w05_large_sample_places", 0)):
    query(name, "SELECT image_key, row_number() OVER (ORDER BY md5('7:' || image_key), image_key) - 1 AS place FROM (SELECT image_key FROM records ORDER BY md5('7:' || image_key), image_key LIMIT 90)")(
        lambda t, limit=limit: placed(od.sample(t.records, 90, 7, merged=limit))
    )
query("w01_page_numbers", f"SELECT image_key, rn // 80 AS page, CAST(ceil(n / 80) AS BIGINT) AS num_pages FROM ({BY_KEY})")(
    lambda t: od.page_numbers(in_order(t), 80).select("image_key", "page", "num_pages")
)
RATIO = "CASE WHEN rn < floor(0.7 * n) THEN 0 WHEN rn < floor(0.9 * n) THEN 1 ELSE 2 END"
for name, source, index in (("", BY_KEY, in_order), ("_shuffled", SHUFFLED, shuffled)):
    query(f"w02_split_ratio{name}", f"SELECT image_key, {RATIO} AS part FROM ({source})")(
        lambda t, index=index: od.split_by_ratio(index(t), [7, 2, 1]).select("image_key", "part")
    )
    query(f"w03_split_n{name}", f"SELECT image_key, rn // CAST(ceil(n / 7) AS BIGINT) AS part FROM ({source})")(
        lambda t, index=index: od.split_in_n(index(t), 7).select("image_key", "part")
    )
    query(f"w04_batches{name}", f"SELECT image_key, rn // 64 AS batch_id FROM ({source})")(
        lambda t, index=index: od.batches(index(t), 64).select("image_key", "batch_id")
    )
query("w05_head", "SELECT image_key FROM records WHERE aesthetic_score > 3 ORDER BY ord LIMIT 25")(
    lambda t: od.head(t.records, 25, [F.col("ord")], F.col("aesthetic_score") > 3).select("image_key")
)
query("w05_sample", "SELECT image_key FROM records WHERE aesthetic_score > 3 ORDER BY md5('7:' || image_key), image_key LIMIT 25")(
    lambda t: od.sample(t.records, 25, 7, F.col("aesthetic_score") > 3).select("image_key")
)
query(
    "w06_sample_unseen",
    "SELECT image_key FROM records WHERE image_key NOT IN (SELECT image_key FROM edits) ORDER BY md5('7:' || image_key), image_key LIMIT 25",
    "records", "edits",
)(lambda t: od.sample_unseen(t.records, t.edits, 25, 7).select("image_key"))
query(
    "w07_cap_per_group",
    """WITH r AS (SELECT image_key, category, row_number() OVER (PARTITION BY category ORDER BY ord) AS rn FROM records),
    e AS (SELECT category, count(*) % 50 AS already_exist FROM other GROUP BY category)
    SELECT image_key, r.category FROM r LEFT JOIN e ON e.category = r.category WHERE rn <= 100 - coalesce(already_exist, 0)""",
    "records", "other",
)(
    lambda t: od.cap_per_group(
        t.records.withColumn("category", paths.category(F.col("image_path"))), "category", ["ord"], 100,
        t.other.groupBy(paths.category(F.col("image_path")).alias("category")).agg((F.count(F.lit(1)) % 50).alias("already_exist")),
    ).select("image_key", "category")
)

query(
    "w07_cap_hot_group",
    """WITH r AS (SELECT image_key, CASE WHEN ord % 3 > 0 THEN 'hot' ELSE category END AS grp, ord FROM records)
    SELECT image_key, grp FROM r QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) <= 1200""",
    "records",
)(
    lambda t: od.cap_per_group(
        t.records.withColumn("grp", F.when(F.col("ord") % 3 > 0, "hot").otherwise(paths.category(F.col("image_path")))), "grp", ["ord"], 1200
    ).select("image_key", "grp")
)

# -- sorts --------------------------------------------------------------------------------------------------------------

LOW, HIGH = "'-infinity'::DOUBLE", "'infinity'::DOUBLE"
QUALITY = (
    f"CASE {q.quality(q.join('tags'))} WHEN 'horrible' THEN 0 WHEN 'worst' THEN 2 WHEN 'low' THEN 3.5 WHEN 'normal' THEN 5 "
    "WHEN 'high' THEN 6.5 WHEN 'best' THEN 8 WHEN 'amazing' THEN 10 ELSE 5 END"
)
TARGET = "c4ca4238a0b92382"
DISTANCE = (
    f"coalesce(bit_count(xor(('0x' || substr(perceptual_hash, 1, 8))::BIGINT, {int(TARGET[:8], 16)})) + "
    f"bit_count(xor(('0x' || substr(perceptual_hash, 9, 8))::BIGINT, {int(TARGET[8:], 16)})), {HIGH})"
)
SORTS = {
    "o03_01_key": ("key", "image_key"),
    "o03_01_stem": ("stem", "image_key"),
    "o03_01_extension": ("extension", r"regexp_extract(image_path, '\.[^./]*$')"),
    "o03_01_category": ("category", "category"),
    "o03_02_hash_distance": ("perceptual_hash", DISTANCE),
    "o03_03_score": ("aesthetic_score", f"coalesce(aesthetic_score, {LOW})"),
    "o03_04_area": ("original_size", "width * height"),
    "o03_04_width": ("original_width", "width"),
    "o03_04_height": ("original_height", "height"),
    "o03_04_aspect_ratio": ("original_aspect_ratio", "width / height"),
    "o03_05_caption_length": ("caption_length", f"coalesce(len(tags), {LOW})"),
    "o03_06_has_gen_info": ("has_gen_info", "category = 'F'"),
    "o03_07_quality": ("quality", QUALITY),
    "o03_08_quality_or_score": ("quality_or_score", f"coalesce(aesthetic_score, {QUALITY})"),
    "o03_09_random": ("random", "md5('0:' || image_key)"),
    "o03_10_safe_rating": ("safe_rating", "safe_rating"),
    "o03_10_safe_level": ("safe_level", "CASE safe_level WHEN 'g' THEN 0 WHEN 's' THEN 1 WHEN 'q' THEN 2 WHEN 'e' THEN 3 ELSE 4 END"),
}


def sortable(t: Tables) -> DataFrame:
    made = F.create_map(F.lit("Steps"), F.lit("20"))
    return t.records.withColumn("gen_info", F.when(F.col("description").endswith("F"), made))


def ranked(methods, reverse: bool, **options):
    return lambda t: so.rank_records(sortable(t), methods, reverse, **options).select("image_key", F.col("row_index").alias("position"))


def rank_sql(*columns: str) -> str:
    return f"SELECT image_key, row_number() OVER (ORDER BY {', '.join(columns)}, ord) - 1 AS position FROM records"


for sort_name, (method, expression) in SORTS.items():
    extra = {"target": TARGET} if method == "perceptual_hash" else {}
    query(sort_name, rank_sql(expression))(ranked([method], False, **extra))
query("o01_sort_multi", rank_sql("category", QUALITY, f"coalesce(aesthetic_score, {LOW})"))(
    ranked(["category", "quality", "aesthetic_score"], False)
)
query(
    "o01_sort_multi_reverse",
    rank_sql(f"{SORTS['o03_10_safe_level'][1]} DESC", f"coalesce(len(tags), {LOW}) DESC", f"coalesce(aesthetic_score, {LOW}) DESC"),
)(ranked(["safe_level", "caption_length", "aesthetic_score"], True))
query("o02_sort_keys", rank_sql("image_key"))(ranked(["key"], False))
query(
    "o01_sorted_first_page",
    f"SELECT image_key, aesthetic_score FROM records ORDER BY {QUALITY} DESC, coalesce(aesthetic_score, {LOW}) DESC, ord LIMIT 80",
)(lambda t: so.sort_records(t.records, ["quality", "aesthetic_score"], True).limit(80).select("image_key", "aesthetic_score"))

# -- hashes ---------------------------------------------------------------------------------------------------------------

query(
    "x01_nearest_hashes",
    """SELECT h.vec_id, bit_count(xor(h.h1, 1431655765::BIGINT)) + bit_count(xor(h.h2, 858993459::BIGINT)) AS distance FROM hashes h
       ORDER BY distance, vec_id LIMIT 20""",
    "hashes",
)(lambda t: nd.nearest(t.hashes, 0x55555555, 0x33333333, 20))
GAP = "bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2))"
query(
    "x01_record_distance",
    f"SELECT image_key, {DISTANCE} AS distance FROM records WHERE perceptual_hash IS NOT NULL",
)(
    lambda t: t.records.filter(F.col("perceptual_hash").isNotNull()).select("image_key", so.hash_distance(TARGET).alias("distance"))
)
query(
    "x02_near_pairs",
    f"""WITH d AS (SELECT DISTINCT h1, h2 FROM hashes)
    SELECT a.h1 AS a1, a.h2 AS a2, b.h1 AS b1, b.h2 AS b2, {GAP} AS distance FROM d a JOIN d b ON (a.h1 < b.h1 OR (a.h1 = b.h1 AND a.h2 < b.h2)) AND {GAP} <= 7""",
    "hashes",
)(lambda t: nd.hash_pairs(t.hashes.select("h1", "h2").distinct()))
query(
    "x02_drop_near_duplicates",
    f"SELECT vec_id, h1, h2 FROM hashes a WHERE NOT EXISTS (SELECT 1 FROM hashes b WHERE b.vec_id < a.vec_id AND {GAP} <= 7)",
    "hashes",
)(lambda t: nd.drop_near_duplicates(t.hashes).select("vec_id", "h1", "h2"))
query(
    "x02_near_pairs_five_bands",
    f"""WITH d AS (SELECT DISTINCT h1, h2 FROM hashes)
    SELECT a.h1 AS a1, a.h2 AS a2, b.h1 AS b1, b.h2 AS b2, {GAP} AS distance FROM d a JOIN d b ON (a.h1 < b.h1 OR (a.h1 = b.h1 AND a.h2 < b.h2)) AND {GAP} <= 9""",
    "hashes",
)(lambda t: nd.hash_pairs(t.hashes.select("h1", "h2").distinct(), distance=9, bands=5))


def dense(t: Tables) -> DataFrame:
    """The hashes and a cluster: every one again, moved next to one point."""
    moved = t.hashes.select((F.col("vec_id") + 5000000).alias("vec_id"), F.col("h1").bitwiseAND(F.lit(15).cast("bigint")).alias("h1"), F.lit(77).cast("bigint").alias("h2"))
    return t.hashes.unionByName(moved)


query(
    "x02_drop_dense_cluster",
    f"""WITH d AS (SELECT vec_id, h1, h2 FROM hashes UNION ALL SELECT vec_id + 5000000, h1 & 15, 77 FROM hashes)
    SELECT vec_id, h1, h2 FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.vec_id < a.vec_id AND {GAP} <= 7)""",
    "hashes",
)(lambda t: nd.drop_near_duplicates(dense(t), hot_bucket=5).select("vec_id", "h1", "h2"))

# -- files ------------------------------------------------------------------------------------------------------------------


def through_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    wr.write_csv(t.full, path)
    return dumped(rd.read_record_csv(t.spark, path))


def through_lines(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    wr.write_json(t.full, path)
    return dumped(rd.read_record_lines(t.spark, path))


def upserted(t: Tables) -> DataFrame:
    """Append means upsert: the second write wins for keys that are stored already."""
    first, second = scratch_path(t.spark, "stored"), scratch_path(t.spark, "merged")
    wr.write_json(t.slim, first)
    wr.write_json(t.other, second, stored=rd.read_record_lines(t.spark, first))
    return rd.read_record_lines(t.spark, second).select("image_key", "image_path", "caption", "aesthetic_score")


def folder(t: Tables, purpose: str) -> str:
    """A new folder that all executors mount, as a plain path."""
    return re.sub(r"\Afile:(//)?(?=/)", "", scratch_path(t.spark, purpose))


def below(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), path)


def relative(base: str, path: Column) -> Column:
    return F.substring(path, len(base) + 1, 2**31 - 1)


#: Records whose files lie on disk at a time: a file takes a block of it, 4 KB mostly, however short.
FILES = 500_000


Work = Callable[[str, DataFrame, wr.Spares | None], tuple[DataFrame, DataFrame]]


def by_parts(t: Tables, records: DataFrame, purpose: str, work: Work) -> DataFrame:
    """``work(folder, records, spares)`` on parts of about ``FILES`` records, one after the other; it gives the files' manifest and the rows.

    Every part has a folder of its own.  When its rows are stored its files become those of the next part, as far as that
    has any use for them; the last ones go.  File systems take far longer to remove a file and make another (they avoid
    what was freed a minute ago).  Records of one stem are in one part.
    """
    records = materialise(records, "records")  # derived once for all parts
    parts = max(1, -(-records.count() // FILES))
    if parts > 1:
        path = scratch_path(t.spark, "parts")
        part = F.pmod(F.xxhash64(paths.label_path(F.col("image_path"))), F.lit(parts)).cast("int")
        records = records.withColumn("part", part)
        records.write.partitionBy("part").parquet(path)
        records = t.spark.read.schema(records.schema).parquet(path)
    tasks, found, spares = int(t.spark.conf.get("spark.sql.shuffle.partitions")), [], None
    sizes = dict(records.groupBy("part").count().collect()) if parts > 1 else {}
    for number in range(parts):
        some = records.filter(F.col("part") == number).drop("part") if parts > 1 else records
        manifest, rows = work(folder(t, purpose), some.repartition(tasks), spares)  # short rows that each mean work
        found.append(scratch_path(t.spark, "part-rows"))
        rows.write.parquet(found[-1])
        files, after = manifest.count(), sizes.get(number + 1, 0)
        surplus = files - min(files, -(-files * after // sizes.get(number, 1))) if after else files
        wr.remove_texts(manifest.limit(surplus) if after else manifest, wr.mounted_removal)
        spares = wr.Spares(manifest.select("path"), wr.mounted_reuse, wr.mounted_removal)
    return t.spark.read.schema(rows.schema).parquet(*found)


def listed_images(t: Tables) -> DataFrame:
    """Image and other files of all orders, found again by listing."""

    def listed(base: str, records: DataFrame, spares: wr.Spares | None) -> tuple[DataFrame, DataFrame]:
        suffix = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".webp", ".txt"))), (F.col("ord") % 4 + 1).cast("int"))
        files = records.select(below(base, F.concat(F.regexp_replace("image_path", r"\.[^./]*\z", ""), suffix)).alias("path"), F.lit("x").alias("text"))
        manifest = materialise(wr.write_texts(files, wr.mounted_text, spares), "manifest")
        images = rd.list_images(t.spark, base, mount=rd.MOUNTED)
        return manifest, images.select("image_key", relative(base, F.col("image_path")).alias("image_path"), "length")

    return by_parts(t, t.records.select("ord", "image_path"), "images", listed)


def through_objects(t: Tables) -> DataFrame:
    """Files of ``{key: record}`` with numbers as text, and a damaged one beside them."""
    path = scratch_path(t.spark, "objects")
    wr.write_record_json(t.full.withColumn("aesthetic_score", F.col("aesthetic_score").cast("string")), path)
    t.table("region").limit(1).select(F.lit('{"broken": {"caption": "x"').alias("value")).write.mode("append").text(path)
    return rd.read_record_json(t.spark, path, indent=None)


query(
    "s01_list_folder",
    r"SELECT image_key, regexp_replace(image_path, '\.[^./]*$', '') || ['.png', '.jpg', '.webp', '.txt'][ord % 4 + 1] AS image_path, 1 AS length FROM records WHERE ord % 4 < 3",
)(listed_images)
query("s03_json_objects", VIEW, "full")(lambda t: dumped(through_objects(t)))
query("s03_damaged_parts", "SELECT 1 AS n")(lambda t: damaged(t))


def damaged(t: Tables) -> DataFrame:
    """How many parts of each damaged file can't be read."""
    path = scratch_path(t.spark, "objects")
    wr.write_record_json(t.slim, path)
    t.table("region").limit(1).select(F.lit('{"broken": {"caption": "x"').alias("value")).write.mode("append").text(path)
    return rd.damaged_parts(t.spark, path, indent=None).select("n")


query("s12_json_lines_round_trip", VIEW, "full")(through_lines)
query("s04_s13_csv_round_trip", VIEW, "full")(through_csv)
query(
    "s12_json_upsert",
    "SELECT image_key, image_path, array_to_string(tags, ', ') AS caption, aesthetic_score FROM other UNION ALL "
    "SELECT image_key, image_path, array_to_string(tags, ', '), aesthetic_score FROM records WHERE image_key NOT IN (SELECT image_key FROM other)",
    "records", "other",
)(upserted)


def labelled(t: Tables) -> DataFrame:
    """Captions of some records written beside their images by the sink and read again."""

    def read_again(base: str, records: DataFrame, spares: wr.Spares | None) -> tuple[DataFrame, DataFrame]:
        images = records.withColumn("image_path", below(base, F.col("image_path")))
        manifest = materialise(wr.write_captions(images.filter(F.col("safe_level") != "g"), wr.mounted_text, spares), "manifest")
        found = rd.attach_sidecars(images.select("image_key", "image_path"), rd.read_captions(t.spark, base, rd.MOUNTED))
        return manifest.withColumnRenamed("label_path", "path"), found.select("image_key", "tags")

    return by_parts(t, t.records.select("image_key", "image_path", "safe_level", "tags"), "captions", read_again)


query(
    "s05_sidecar_captions",
    "SELECT image_key, CASE WHEN safe_level <> 'g' THEN array_to_string(tags, ', ') END AS caption FROM records",
)(lambda t: labelled(t).select("image_key", tg.render(F.col("tags")).alias("caption")))


def with_metadata(t: Tables) -> DataFrame:
    """Text sidecars for some images, empty for a few, and hidden or plain metadata files for all with lines."""

    def read_again(base: str, records: DataFrame, spares: wr.Spares | None) -> tuple[DataFrame, DataFrame]:
        images = records.withColumn("image_path", below(base, F.col("image_path")))
        path = F.col("image_path")
        texts = images.filter(F.col("safe_level") == "g").select(
            paths.label_path(path).alias("path"), F.when(F.col("ord") % 5 == 0, "").otherwise("from text").alias("text")
        )
        hidden = paths.with_name(path, F.concat(F.lit("."), paths.stem(path), F.lit("_meta.json")))
        metas = images.filter(F.col("payload").isNotNull()).select(
            F.when(F.col("safe_level") == "s", hidden).otherwise(F.concat(path, F.lit(".json"))).alias("path"),
            F.when(F.col("safe_level") == "s", F.concat(F.lit('{"danbooru":'), "payload", F.lit("}"))).otherwise(F.col("payload")).alias("text"),
        )
        manifest = materialise(wr.write_texts(texts.union(metas), wr.mounted_text, spares), "manifest")
        found = rd.read_booru_meta(t.spark, base, rd.MOUNTED).unionByName(rd.read_hidden_meta(images, rd.mounted_text))
        read = rd.attach_sidecars(images.select("image_key", "image_path"), rd.fetch_captions(images, rd.mounted_text), found)
        return manifest, read.select("image_key", tg.render(F.col("tags")).alias("caption"), F.col("original_size.width").cast("bigint").alias("width"))

    posts = booru(t).select(F.concat(F.lit("img"), F.col("l_orderkey").cast("string")).alias("image_key"), "payload")
    return by_parts(t, t.records.select("ord", "image_key", "image_path", "safe_level").join(posts, "image_key", "left"), "sidecars", read_again)


query(
    "s06_sidecar_metadata",
    f"""WITH {META_SQL.strip()},
    firsts AS (SELECT l_orderkey, list_filter(list_transform(k, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(k, s.x) = s.i) AS f FROM kept)
    SELECT image_key, CASE WHEN safe_level = 'g' THEN CASE WHEN ord % 5 > 0 THEN 'from text' END ELSE array_to_string(list_transform(f, lambda s: replace(s.x, '_', ' ')), ', ') END AS caption,
      CASE WHEN safe_level <> 'g' THEN len(t) END AS width
    FROM records LEFT JOIN firsts f ON f.l_orderkey = ord LEFT JOIN split s ON s.l_orderkey = ord""",
)(with_metadata)
query(
    "s08_load_sources",
    "SELECT image_key, image_path FROM records WHERE starts_with(image_key, 'img1') AND image_key NOT IN (SELECT image_key FROM other) "
    "UNION ALL SELECT image_key, image_path FROM other WHERE starts_with(image_key, 'img1')",
    "records", "other",
)(
    lambda t: rd.load([t.other, t.slim], key_condition=F.col("image_key").startswith("img1"), order="ord").select("image_key", "image_path")
)
query("s10_key_condition", "SELECT image_key FROM records WHERE regexp_matches(image_key, '^img[0-9]*7$')")(
    lambda t: rd.load([t.slim], key_condition=F.col("image_key").rlike("^img[0-9]*7$")).select("image_key")
)


def post_database(t: Tables) -> DataFrame:
    """Post tables written as Parquet folders and read back by name."""
    base = scratch_path(t.spark, "posts")
    for name, df in (("post", t.posts), ("tag", t.tag_rows), ("tag_wikis", t.wiki)):
        df.write.parquet(f"{base}/{name}")
    tables = rd.read_tables(t.spark, base)
    return tables["tag"].join(tables["tag_wikis"].select("id", "description"), "id", "left").select("id", "name", "count", "description")


query(
    "s11_post_tables",
    "SELECT id, p_name AS name, cnt AS count, CASE WHEN NOT contains(p_name, 'old ') THEN 'about ' || p_name END AS description FROM names",
    "names",
)(post_database)
query(
    "s14_label_check",
    "SELECT image_key, caption IS NULL AS missing_image, safe_level = 's' AS overwrites_label FROM records",
)(
    lambda t: wr.label_check(
        t.records, t.listing,
        t.records.filter(F.col("safe_level") == "s").select(paths.label_path(F.col("image_path")).alias("label_path")),
    )
)
query(
    "s14_caption_manifest",
    r"SELECT image_key, regexp_replace(image_path, '\.[^./]*$', '.txt') AS label_path, strlen(array_to_string(tags, ', ')) AS bytes, 'written' AS status FROM records WHERE len(tags) > 0",
)(lambda t: written_captions(t))


def written_captions(t: Tables) -> DataFrame:
    base = folder(t, "captions")
    images = t.records.withColumn("image_path", below(base, F.col("image_path")))
    manifest = materialise(wr.write_captions(images, wr.mounted_text), "manifest")
    return manifest.withColumn("label_path", relative(base, F.col("label_path")))


def statistics(t: Tables) -> DataFrame:
    """One statistic table per kind of part, in the four shapes, written a character a text and read again in splits."""
    names = t.table("part").groupBy("p_type", "p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice") + 0.5, 2).alias("price"))
    kind, quoted = F.col("p_type"), lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    value = (
        F.when(kind == "SMALL", F.col("price").cast("string"))
        .when(kind == "MEDIUM", F.concat(F.lit("["), F.concat_ws(", ", F.col("n").cast("string"), F.col("price").cast("string")), F.lit("]")))
        .otherwise(F.col("n").cast("string"))
    )
    tag = F.when(kind == "PROMO", quoted(F.col("p_name"))).otherwise(F.concat(quoted(F.col("p_name")), F.lit(": "), value))
    characters = names.groupBy("p_type", "p_brand").agg(F.array_join(F.sort_array(F.collect_list(tag)), ",\n        ").alias("body"))
    mark = lambda plain, listed: F.when(kind == "PROMO", listed).otherwise(plain)
    text = F.concat(F.lit('    "'), F.concat_ws("/", "p_type", "p_brand"), mark('": {\n        ', '": [\n        '), "body", mark("\n    },", "\n    ],"))
    path = scratch_path(t.spark, "statistics")
    rows = characters.repartitionByRange("p_type", "p_brand").sortWithinPartitions("p_type", "p_brand").select("p_type", text.alias("value"))
    rows.filter(kind != "PROMO").write.partitionBy("p_type").text(f"{path}/objects")
    rows.filter(kind == "PROMO").select("value").write.text(f"{path}/lists")
    return rd.read_statistics(t.spark, f"{path}/objects").unionByName(rd.read_statistics(t.spark, f"{path}/lists", lists=True))


query(
    "s16_statistic_tables",
    """SELECT p_type || '/' || p_brand AS character, p_name AS tag, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN count(*) END AS cnt,
       CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN round(avg(p_retailprice) + 0.5, 2) END AS freq FROM part GROUP BY p_type, p_brand, p_name""",
)(statistics)
query(
    "a05_feature_table_from_file",
    """SELECT DISTINCT lower(p_type || '/' || p_brand) AS character, p_name AS feature FROM part
       WHERE p_type = 'PROMO' OR (p_type IN ('SMALL', 'MEDIUM') AND regexp_matches(p_name, '^(?:.*\\b(?:red|old|hot)\\b.*)'))""",
)(lambda t: rd.feature_table(statistics(t), t.feature_patterns, 0.3, 1, 10**9))
