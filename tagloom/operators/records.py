"""Record projections, tabular view and attribute trackers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, paths, tags as tg
from ..schema import RECORD, TABULAR, list_to_text


def with_caption_attrs(df: DataFrame, style_tags: Sequence[str] = (), typed: str = "typed") -> DataFrame:
    """Add artist, quality, characters and styles derived from the typed list."""
    items = F.col(typed)
    return df.withColumns(
        {
            "artist": dv.artist(dv.plain(items)),
            "quality": dv.quality(dv.plain(items)),
            "characters": dv.characters(items),
            "styles": dv.styles(items, style_tags),
        }
    )


def tabular(df: DataFrame, tags: str = "tags") -> DataFrame:
    """The tabular view in its fixed column order, lists as text; absent attributes are null."""
    present = set(df.columns)

    def column(name: str) -> Column:
        if name == "caption" and tags in present:
            return list_to_text(F.col(tags)).alias(name)
        if name in ("characters", "styles") and name in present:
            return list_to_text(F.col(name)).alias(name)
        if name in present:
            return F.col(name)
        absent = RECORD[name].dataType if name in RECORD.fieldNames() else "string"
        return F.lit(None).cast(absent).alias(name)

    return df.select(*[column(name) for name in TABULAR])


def project(df: DataFrame, attrs: Sequence[str] | None = None, tags: str = "tags") -> DataFrame:
    """Record projection with an optional subset of attributes."""
    view = tabular(df, tags)
    return view if attrs is None else view.select("image_key", *attrs)


def rename_by_map(df: DataFrame, stem_map: DataFrame, path: str = "image_path") -> DataFrame:
    """Rename files whose stem is in ``stem_map(stem, new_stem)``."""
    old = F.col(path)
    return (
        df.withColumn("__stem", paths.stem(old))
        .join(stem_map.select(F.col("stem").alias("__stem"), "new_stem"), "__stem", "left")
        .withColumn(
            path,
            F.when(
                F.col("new_stem").isNotNull(), paths.with_name(old, F.concat("new_stem", paths.suffix(old)))
            ).otherwise(old),
        )
        .drop("__stem", "new_stem")
    )


def track_path(df: DataFrame, target: DataFrame, key: str = "image_key") -> DataFrame:
    """Take the path of the same record in the target set, if it is there."""
    other = target.select(key, F.col("image_path").alias("__path"))
    return (
        df.join(other, key, "left").withColumn("image_path", F.coalesce("__path", "image_path")).drop("__path")
    )


def track_caption(df: DataFrame, target: DataFrame, key: str = "image_key", tags: str = "tags") -> DataFrame:
    """Take the caption of the same record in the target set, if it has tags there."""
    other = target.filter(F.size(tags) > 0).select(key, F.col(tags).alias("__tags"))
    return df.join(other, key, "left").withColumn(tags, F.coalesce("__tags", tags)).drop("__tags")


def artist_from_category(path: Column) -> Column:
    folder = paths.category(path)
    return F.when(folder.startswith("by "), F.substr(folder, F.lit(4)))


def track_artist(df: DataFrame, typed: str = "typed", tags: str = "tags", path: str = "image_path") -> DataFrame:
    """Set the artist of captioned records from a category named ``by X``."""
    edited = dv.with_artist(F.col(typed), artist_from_category(F.col(path)))
    return df.withColumn(tags, F.when(F.size(tags) > 0, edited).otherwise(F.col(tags)))


def track_everything(df: DataFrame, target: DataFrame, retype, key: str = "image_key") -> DataFrame:
    """Path and caption from the target set in one join, then artist and characters from the result.

    ``retype`` adds the ``typed`` column to a DataFrame (see ``operators.dictionary.with_typed_tags``).
    """
    other = target.select(
        key,
        F.col("image_path").alias("__path"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("__tags"),
    )
    merged = (
        df.drop("typed")
        .join(other, key, "left")
        .withColumn("image_path", F.coalesce("__path", "image_path"))
        .withColumn("tags", F.coalesce("__tags", "tags"))
        .drop("__path", "__tags")
    )
    tracked = retype(track_artist(retype(merged)).drop("typed"))
    return tracked.withColumn("characters", dv.characters(F.col("typed")))


def clear(df: DataFrame, *attrs: str) -> DataFrame:
    """Set attributes (score, hash, …) to null, keeping their types."""
    types = dict(df.dtypes)
    return df.withColumns({a: F.lit(None).cast(types[a]) for a in attrs})


def rekey(df: DataFrame, path: str = "image_path", key: str = "image_key") -> DataFrame:
    """Recompute keys from paths."""
    return df.withColumn(key, paths.stem(F.col(path)))


def fill_add(df: DataFrame, new: Sequence[str], append: bool = False, tags: str = "tags",
             path: str = "image_path") -> DataFrame:
    """Add tags, filling category and stem templates from the record's path."""
    p = F.col(path)
    return df.withColumn(tags, tg.add(F.col(tags), new, append, paths.category(p), paths.stem(p)))
