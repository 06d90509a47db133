"""Queries of record projections, metadata columns and predictions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import hashes as hs, metadata as md, paths, tags as tg
from ..operators import batch, lookup as lk, predictions as pr, records as rc
from ..runtime import explode_rows
from ..schema import BOORU_META, round3
from . import sqltext as q
from .captions import out, rows
from .registry import query
from .tables import Tables


def P() -> Column:
    return F.col("image_path")


# -- paths ------------------------------------------------------------------------------------------------

query("p01_stem", r"SELECT image_path, regexp_extract(image_path, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM records")(
    lambda t: t.records.select("image_path", paths.stem(P()).alias("stem"))
)
query("p02_suffix", r"SELECT image_path, regexp_extract(image_path, '\.[^./]*$') AS suffix FROM records")(
    lambda t: t.records.select("image_path", paths.suffix(P()).alias("suffix"))
)
query("p03_category", "SELECT image_path, string_split(image_path, '/')[-2] AS category FROM records")(
    lambda t: t.records.select("image_path", paths.category(P()).alias("category"))
)
query(
    "p04_source_root",
    "SELECT image_path, regexp_replace(image_path, '/[^/]+/[^/]+$', '') AS source, regexp_replace(image_path, '/[^/]+/[^/]+/[^/]+$', '') AS root FROM records",
)(lambda t: t.records.select("image_path", paths.source(P()).alias("source"), paths.root(P()).alias("root")))
query("p05_label_path", r"SELECT image_path, regexp_replace(image_path, '\.[^./]*$', '.txt') AS label_path FROM records")(
    lambda t: t.records.select("image_path", paths.label_path(P()).alias("label_path"))
)
query(
    "p01_url_name",
    r"SELECT page_id, regexp_extract(u, '([^/]+?)(\.[^./]*)?$', 1) AS stem, string_split(u, '/')[-2] AS category "
    r"FROM (SELECT page_id, regexp_replace(url, '[?#].*', '') AS u FROM pages)",
)(
    lambda t: t.table("pages").withColumn("u", F.regexp_replace("url", "[?#].*", "")).select(
        "page_id", paths.stem(F.col("u")).alias("stem"), paths.category(F.col("u")).alias("category")
    )
)

# -- views ----------------------------------------------------------------------------------------------------


def dumped(df):
    """Structs as text, so that views compare as plain columns."""
    size = F.col("original_size")
    return df.withColumn("original_size", F.concat_ws("x", size["width"].cast("string"), size["height"].cast("string")))


VIEW = (
    "SELECT image_key, image_path, array_to_string(tags, ', ') AS caption, description, width || 'x' || height AS original_size, "
    "aesthetic_score, safe_level, safe_rating, perceptual_hash, artist, quality, array_to_string(characters, ', ') AS characters, "
    "array_to_string(styles, ', ') AS styles FROM full_records"
)
query("p06_tabular_view", VIEW, "full")(lambda t: dumped(rc.tabular(t.full)))
query(
    "p07_projection",
    "SELECT image_key, array_to_string(tags, ', ') AS caption, artist, array_to_string(characters, ', ') AS characters FROM full_records",
    "full",
)(lambda t: rc.project(t.full, ["caption", "artist", "characters"]))
query(
    "p08_coercion",
    "SELECT o_orderkey, round(CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) / 7, 3) AS score FROM orders",
)(lambda t: t.table("orders").select("o_orderkey", round3(F.col("o_totalprice").cast("string").cast("double") / 7).alias("score")))
query(
    "p09_templates",
    rows("list_concat(['in ' || category || '/' || category, image_key || '!'], list_filter(coalesce(tags, []), lambda x: x <> 'in ' || category || '/' || category AND x <> image_key || '!'))"),
)(lambda t: out(rc.fill_add(t.records, ["in %dir%/%category%", "%filename%!"]), F.col("tags")))
query(
    "p10_rename",
    r"""WITH m AS (SELECT 'img' || l_orderkey AS stem, 'pic' || max(l_partkey) AS new_stem FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT image_key, CASE WHEN new_stem IS NULL THEN image_path ELSE regexp_replace(image_path, '[^/]+$', '') || new_stem
      || regexp_extract(image_path, '\.[^./]*$') END AS image_path FROM records LEFT JOIN m ON stem = image_key""",
)(
    lambda t: rc.rename_by_map(
        t.slim,
        t.table("lineitem").filter(F.col("l_returnflag") == "R").groupBy(F.concat(F.lit("img"), F.col("l_orderkey").cast("string")).alias("stem"))
        .agg(F.concat(F.lit("pic"), F.max("l_partkey").cast("string")).alias("new_stem")),
    ).select("image_key", "image_path")
)
query(
    "p11_track_path",
    "SELECT r.image_key, coalesce(o.image_path, r.image_path) AS image_path FROM records r LEFT JOIN other o ON o.image_key = r.image_key",
    "records", "other",
)(lambda t: rc.track_path(t.slim, t.other).select("image_key", "image_path"))
query(
    "p12_track_caption",
    "SELECT r.image_key, array_to_string(CASE WHEN len(o.tags) > 0 THEN o.tags ELSE r.tags END, ', ') AS caption FROM records r LEFT JOIN other o ON o.image_key = r.image_key",
    "records", "other",
)(lambda t: out(rc.track_caption(t.slim, t.other), F.col("tags")))

BY = "'/art/by ' || lower(p_brand) || '/part' || p_partkey || '.jpg'"


def catalogue(t: Tables):
    """Parts as records in folders named after their brand, captions with and without an artist."""
    path = F.concat(F.lit("/art/by "), F.lower("p_brand"), F.lit("/part"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    tags = F.when(F.col("p_size") <= 20, F.array(F.concat(F.lit("by "), F.col("p_name")), F.lower("p_type")))
    tags = tags.when(F.col("p_size") <= 40, F.array("p_name"))
    return t.table("part").select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("image_key"), path.alias("image_path"), tags.alias("tags")
    )


CATALOGUE = f"""c AS (SELECT 'part' || p_partkey AS image_key, lower(p_brand) AS brand, p_name,
    CASE WHEN p_size <= 20 THEN ['by ' || p_name, lower(p_type)] WHEN p_size <= 40 THEN [p_name] END AS tags FROM part)"""
TRACKED = (
    "CASE WHEN tags IS NULL THEN NULL WHEN starts_with(tags[1], 'by ') THEN "
    "list_concat(['by ' || brand], tags[2:]) ELSE list_concat(['artist: ' || brand], tags) END"
)
query("p13_track_artist", f"WITH {CATALOGUE} SELECT image_key, {q.join(TRACKED)} AS caption FROM c", "dict")(
    lambda t: out(rc.track_artist(t.retype(catalogue(t))), F.col("tags"))
)
query(
    "p14_track_everything",
    f"""WITH m AS (SELECT r.image_key, coalesce(o.image_path, r.image_path) AS image_path, CASE WHEN len(o.tags) > 0 THEN o.tags ELSE r.tags END AS tags
      FROM records r LEFT JOIN other o ON o.image_key = r.image_key),
    w AS (SELECT m.*, {q.typed_list('tags')} AS typed FROM m CROSS JOIN kinds)
    SELECT image_key, image_path, {q.join('tags')} AS caption, {q.join(q.chars())} AS characters FROM w""",
    "records", "other", "dict",
)(
    lambda t: rc.track_everything(t.slim, t.other, t.retype).select(
        "image_key", "image_path", tg.render(F.col("tags")).alias("caption"), tg.render(F.col("characters")).alias("characters")
    )
)
query(
    "p15_change_paths",
    r"SELECT image_key, '/data/new/' || category || '/' || regexp_extract(image_path, '[^/]+$') AS source_changed, "
    r"regexp_replace(image_path, '\.[^./]*$', '.webp') AS ext_changed, "
    r"regexp_replace(image_path, '/[^/]+/[^/]+$', '') || '/moved/' || regexp_extract(image_path, '[^/]+$') AS category_changed FROM records",
)(
    lambda t: t.records.select(
        "image_key",
        paths.change_source(P(), "new").alias("source_changed"),
        paths.with_suffix(P(), ".webp").alias("ext_changed"),
        paths.change_category(P(), "moved").alias("category_changed"),
    )
)
query(
    "p16_clear_attributes",
    "SELECT image_key, safe_level, CAST(NULL AS DOUBLE) AS aesthetic_score, CAST(NULL AS VARCHAR) AS perceptual_hash FROM records",
)(lambda t: rc.clear(t.records, "aesthetic_score", "perceptual_hash").select("image_key", "safe_level", "aesthetic_score", "perceptual_hash"))

# -- metadata ----------------------------------------------------------------------------------------------------

META_SQL = """
words AS (
  SELECT l_orderkey, string_agg(replace(p_name, ' ', '_'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tag_string,
         coalesce(string_agg(replace(p_name, ' ', '_'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (p_type = 'LARGE'), '') AS tag_string_artist,
         coalesce(string_agg(replace(p_name, ' ', '_'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (p_type = 'PROMO'), '') AS tag_string_character,
         coalesce(string_agg(replace(p_name, ' ', '_'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (p_type = 'SMALL'), '') AS tag_string_meta
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
split AS (SELECT l_orderkey, string_split(tag_string, ' ') AS t, string_split(tag_string_artist, ' ') AS a,
    string_split(tag_string_character, ' ') AS c, string_split(tag_string_meta, ' ') AS m FROM words),
kept AS (SELECT l_orderkey, list_transform(list_filter(t, lambda x: NOT list_contains(m, x)), lambda x:
    CASE WHEN list_contains(a, x) THEN 'artist: ' || x WHEN list_contains(c, x) THEN 'character: ' || x ELSE x END) AS k FROM split)"""


def booru(t: Tables):
    """Post metadata as JSON text, built from each order's lines."""
    listed = t._line_lists(["p_name", "p_type"])
    form = lambda x: F.replace(x["p_name"], F.lit(" "), F.lit("_"))
    words = lambda kind: F.array_join(
        F.transform(F.filter("items", lambda x: F.lit(True) if kind is None else x["p_type"] == kind), form), " "
    )
    return listed.select(
        "l_orderkey",
        F.to_json(
            F.struct(
                words(None).alias("tag_string"), words("LARGE").alias("tag_string_artist"),
                words("PROMO").alias("tag_string_character"), words("SMALL").alias("tag_string_meta"),
                F.lit("s").alias("rating"), F.size("items").alias("image_width"), F.lit(64).alias("image_height"),
            )
        ).alias("payload"),
    )


def booru_caption(t: Tables):
    meta = booru(t).select("l_orderkey", F.from_json("payload", BOORU_META).alias("meta"))
    return meta.select(
        "l_orderkey", tg.render(md.booru_tags(F.col("meta"))).alias("caption"), F.col("meta.rating").alias("safe_level"),
        F.col("meta.image_width").cast("bigint").alias("width"),
    )


query(
    "m01_booru_metadata",
    f"""WITH {META_SQL.strip()},
    firsts AS (SELECT l_orderkey, list_filter(list_transform(k, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(k, s.x) = s.i) AS f FROM kept)
    SELECT f.l_orderkey, array_to_string(list_transform(f, lambda s: replace(s.x, '_', ' ')), ', ') AS caption, 's' AS safe_level, len(t) AS width
    FROM firsts f JOIN split s ON s.l_orderkey = f.l_orderkey""",
)(booru_caption)

query(
    "m02_gen_parameters",
    """SELECT image_key, coalesce(array_to_string(tags, ', '), '') || ' ' AS positive, CASE WHEN category = 'F' THEN '' ELSE description || ' ' END AS negative,
       CAST(ord % 50 AS VARCHAR) AS steps, width || 'x' || height AS size, safe_level AS sampler, 5 + CAST(category <> 'F' AS INT) * 0 AS n FROM records""",
)(
    lambda t: t.records.select(
        "image_key",
        md.gen_info(
            F.create_map(
                F.lit("parameters"),
                F.concat(
                    F.coalesce(tg.render(F.col("tags")), F.lit("")), F.lit(" "),
                    F.when(~F.col("description").endswith("F"), F.concat(F.lit("Negative prompt: "), F.col("description"), F.lit(" "))).otherwise(""),
                    F.lit("Steps: "), (F.col("ord") % 50).cast("string"), F.lit(", Sampler: first, Sampler: "), F.col("safe_level"),
                    F.lit(", Size: "), F.col("original_size.width").cast("string"), F.lit("x"), F.col("original_size.height").cast("string"),
                ),
            )
        ).alias("g"),
    ).select(
        "image_key", F.col("g")["Positive prompt"].alias("positive"), F.col("g")["Negative prompt"].alias("negative"),
        F.col("g")["Steps"].alias("steps"), F.col("g")["Size"].alias("size"), F.col("g")["Sampler"].alias("sampler"),
        F.size("g").alias("n"),
    )
)
query(
    "m03_gen_comment",
    """SELECT image_key, 'made by ' || safe_level AS title, array_to_string(tags, ', ') AS positive, description AS negative,
       CAST(ord AS VARCHAR) AS seed, CASE WHEN tags IS NULL THEN 4 ELSE 5 END AS n FROM records""",
)(
    lambda t: t.records.select(
        "image_key",
        md.gen_info(
            F.create_map(
                F.lit("Title"), F.concat(F.lit("made by "), F.col("safe_level")),
                F.lit("seed"), F.lit("none"),
                F.lit("Comment"),
                F.to_json(F.struct(tg.render(F.col("tags")).alias("prompt"), F.col("description").alias("uc"), F.col("ord").alias("SEED"))),
            )
        ).alias("g"),
    ).select(
        "image_key", F.col("g")["Title"].alias("title"), F.col("g")["Positive prompt"].alias("positive"),
        F.col("g")["Negative prompt"].alias("negative"), F.col("g")["Seed"].alias("seed"), F.size("g").alias("n"),
    )
)
DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"
query(
    "m04_base36",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, n AS back,
      array_to_string(list_reverse(list_transform(range(CAST(CASE WHEN n = 0 THEN 1 ELSE floor(ln(n + 0.5) / ln(36)) + 1 END AS BIGINT)),
        lambda i: substr({DIGITS}, CAST((n // CAST(36 ** i AS BIGINT)) % 36 AS INT) + 1, 1))), '') AS id36
    FROM (SELECT *, l_orderkey * 1000 + l_partkey AS n FROM lineitem)""",
)(
    lambda t: t.table("lineitem").withColumn("n", F.col("l_orderkey") * 1000 + F.col("l_partkey")).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        md.to_base36(F.col("n")).alias("id36"), md.from_base36(md.to_base36(F.col("n"))).alias("back"),
    )
)
query(
    "m05_codes",
    """SELECT id, ['g', 's', 'q', 'e'][rating + 1] AS rating, has_children <> 0 AS has_children, has_large <> 0 AS has_large FROM posts""",
    "posts",
)(lambda t: lk.post_attributes(t.posts).select("id", "rating", "has_children", "has_large"))

# -- predictions and user functions ---------------------------------------------------------------------------------

query("u06_predicted_captions", "SELECT image_key, array_to_string(predicted, ', ') AS caption FROM predicted", "predictions")(
    lambda t: out(pr.predicted_tags(t.predictions), F.col("predicted"))
)
MERGES = {
    "overwrite": "coalesce(predicted, tags)",
    "ignore": "coalesce(tags, predicted)",
    "append": "CASE WHEN predicted IS NULL THEN tags ELSE list_concat(coalesce(tags, []), list_filter(predicted, lambda x: NOT list_contains(coalesce(tags, []), x))) END",
    "prepend": "CASE WHEN predicted IS NULL THEN tags ELSE list_concat(predicted, list_filter(coalesce(tags, []), lambda x: NOT list_contains(predicted, x))) END",
}
for merge_mode, merge_sql in MERGES.items():
    query(
        f"u07_merge_{merge_mode}",
        f"SELECT r.image_key, {q.join(merge_sql)} AS caption FROM records r LEFT JOIN predicted p ON p.image_key = r.image_key",
        "records", "predictions",
    )(lambda t, mode=merge_mode: out(pr.apply_predictions(t.records, pr.predicted_tags(t.predictions), mode), F.col("tags")))
for merge_mode in ("overwrite", "ignore"):
    clamped = "least(greatest(safe_rating * 15 - 2, 0), 10)"
    expression = f"coalesce(aesthetic_score, {clamped})" if merge_mode == "ignore" else clamped
    query(f"u08_score_{merge_mode}", f"SELECT image_key, round({expression}, 6) AS score FROM records")(
        lambda t, mode=merge_mode: t.records.select(
            "image_key",
            F.round(pr.merge_score(F.col("aesthetic_score"), F.col("safe_rating") * 15 - 2, mode), 6).alias("score"),
        )
    )
query(
    "u09_l2_normalise",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
    SELECT vec_id, i AS dim, round(v[i] / n, 6) AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM n)""",
)(
    lambda t: explode_rows(t.table("embeddings"), ["vec_id"], hs.l2_normalise(F.col("embedding")), "dim", "value", position=True).select(
        "vec_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )
)


def upper_description(frame):
    return frame.assign(description=frame["description"].str.upper())


def to_png(frame):
    return frame.assign(image_path=frame["image_path"].str.replace(r"/img(\d+)\.\w+$", r"/pic\1.png", regex=True))


FIELDS = ["ord", "image_key", "image_path", "description"]
query("u01_map_records", "SELECT ord, image_key, image_path, upper(description) AS description FROM records")(
    lambda t: batch.map_batches(t.records.select(*FIELDS), upper_description)
)
query(
    "u02_map_to_new",
    r"SELECT ord, 'pic' || ord AS image_key, regexp_replace(image_path, '/img(\d+)\.\w+$', '/pic\1.png') AS image_path, description FROM records",
)(lambda t: batch.map_to_new(t.records.select(*FIELDS), to_png))
query(
    "u03_user_predicate",
    "SELECT ord, image_key, image_path, description FROM records WHERE contains(description, 'URGENT') AND category = 'F'",
)(
    lambda t: batch.filter_by(
        batch.filter_by(t.records.select(*FIELDS), F.col("description").contains("URGENT")),
        lambda frame: frame["description"].str.endswith("F"),
    )
)
query("u04_caption_hook", rows("list_concat(['labelled'], predicted)", "predicted"), "predictions")(
    lambda t: out(
        pr.predicted_tags(t.predictions).transform(lambda df: df.withColumn("predicted", tg.append_all(tg.lit_tags(["labelled"]), F.col("predicted")))),
        F.col("predicted"),
    )
)
query(
    "u05_batch_edit",
    """SELECT image_key, array_to_string(CASE WHEN category = 'F' THEN list_concat(['done'], list_filter(coalesce(tags, []), lambda x: x <> 'done')) ELSE tags END, ', ') AS caption
    FROM records""",
)(lambda t: out(batch.edit(t.records, "add_tags", where=paths.category(P()) == "F", new=["done"]), F.col("tags")))


def length_model():
    """A stand-in model: the number of characters of the description."""
    return lambda frame: frame[["image_key"]].assign(score=frame["description"].str.len().astype("int64"))


query("u10_model_batches", "SELECT image_key, length(description) AS score FROM records")(
    lambda t: batch.run_model(t.records.select("image_key", "description"), length_model, "image_key string, score bigint", 32)
)
query(
    "s17_labelling_job",
    """SELECT r.image_key, 'seen ' || description AS caption FROM records r WHERE caption IS NULL
       AND NOT EXISTS (SELECT 1 FROM last_edits e WHERE e.image_key = r.image_key)""",
    "records", "edits",
)(
    lambda t: batch.run_model(
        batch.to_label(t.records, t.edits).select("image_key", "description"),
        lambda: lambda frame: frame[["image_key"]].assign(caption="seen " + frame["description"]),
        "image_key string, caption string",
    )
)
