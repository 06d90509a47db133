"""Post tables, tag dimension and wiki lookups, and the diff of two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metadata as md, paths
from ..functions.rules import TAG_TYPE_CODES
from ..runtime import explode_rows, gather, materialise

KEY = "image_key"
FLAGS = ("has_children", "has_active_children", "has_large", "has_visible_children")


def tag_dimension(rows: DataFrame) -> DataFrame:
    """``(id, name, type, count)`` with the type code resolved."""
    return rows.select("id", "name", md.tag_type_label(F.col("type_id")).alias("type"), "count")


def post_attributes(posts: DataFrame) -> DataFrame:
    """Rating code and integer flags of posts as labels and booleans."""
    flags = {name: md.flag(F.col(name)) for name in FLAGS if name in posts.columns}
    return posts.withColumns({"rating": md.rating_label(F.col("rating")), **flags})


def post_tags(posts: DataFrame, dimension: DataFrame, ids: str = "tag_ids") -> DataFrame:
    """Posts with tag names in id order, also split by type; unknown ids are dropped.

    Every post stays, also those that share an id or have none: posts are written once with a number of their own, that
    number and the tag ids are exploded, joined and brought together, and the written posts take their lists by number.
    """
    written = materialise(posts.withColumn("__row", F.monotonically_increasing_id()), "posts")
    exploded = written.select("__row", F.posexplode(ids).alias("pos", "tag_id"))
    named = exploded.join(dimension.select(F.col("id").alias("tag_id"), "name", "type"), "tag_id").filter("name is not null")
    lists = gather(named, "__row", F.sort_array(F.collect_list(F.struct("pos", "name", "type"))).alias("__tags"))
    tagged = written.join(lists, "__row", "left").drop("__row", ids)
    found = F.when(F.col("__tags").isNotNull(), F.col("__tags")).otherwise(F.array().cast(lists.schema["__tags"].dataType))
    names = lambda items: F.transform(items, lambda x: x["name"])
    of_type = lambda label: names(F.filter("__tags", lambda x: x["type"] == label))
    split = {f"tags_{label}": of_type(label) for label in TAG_TYPE_CODES.values()}
    return tagged.withColumn("__tags", found).withColumns({"tags": names(F.col("__tags")), **split}).drop("__tags")


def wiki_text(names: DataFrame, dimension: DataFrame, wiki: DataFrame, name: str = "name") -> DataFrame:
    """Wiki text per tag name: name to id to text, null where there is none."""
    ids = dimension.select(F.col("name").alias(name), F.col("id").alias("__id"))
    texts = wiki.select(F.col("id").alias("__id"), "description")
    return names.join(ids, name, "left").join(texts, "__id", "left").drop("__id")


def diff(
    left: DataFrame,
    right: DataFrame,
    has_label: str | None = None,
    track_move: bool = True,
    track_remove: bool = True,
    key: str = KEY,
) -> DataFrame:
    """File operations that bring ``left`` in line with ``right``: ``(op_key, op, src, dst)``.

    A category that differs is a move, a key missing in ``right`` a removal.  Records with a label file
    (``has_label`` names a boolean column) yield a second row for it under ``<key>_cap``.
    """
    path = F.col("image_path")
    other = right.select(key, paths.category(F.col("image_path")).alias("__category"), F.lit(True).alias("__there"))
    joined = left.join(other, key, "left")
    moved = F.col("__there") & (F.col("__category") != paths.category(path)) & F.lit(track_move)
    gone = F.col("__there").isNull() & F.lit(track_remove)
    label = F.col(has_label) if has_label else F.lit(False)
    target = paths.change_category(path, F.col("__category"))

    def entry(suffix: str, src, dst):
        return F.struct(
            F.concat(F.col(key), F.lit(suffix)).alias("op_key"), src.alias("src"), dst.alias("dst")
        )

    rows = F.array_compact(
        F.array(
            entry("", path, target),
            F.when(label, entry("_cap", paths.label_path(path), paths.label_path(target))),
        )
    )
    return (
        joined.withColumn("op", F.when(moved, "move").when(gone, "remove"))
        .filter(F.col("op").isNotNull())
        .transform(lambda df: explode_rows(df, ["op"], rows, "r"))
        .select("r.op_key", "op", "r.src", F.when(F.col("op") == "move", F.col("r.dst")).alias("dst"))
    )
