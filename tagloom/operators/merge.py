"""Set operators on keys, multi-source merges, change sets and edit logs.

A merge is an anti-join of the losing side plus a union, so only the losing side's rows and the winning side's
keys are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import normal
from ..runtime import explode_rows

KEY = "image_key"


def intersect(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Records of ``left`` whose key is in ``right``."""
    return left.join(right.select(key), key, "left_semi")


def subtract(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Records of ``left`` whose key is not in ``right``."""
    return left.join(right.select(key), key, "left_anti")


def upsert(base: DataFrame, other: DataFrame, key: str = KEY) -> DataFrame:
    """All records; where a key is in both, the other side's record wins."""
    return subtract(base, other, key).unionByName(other, allowMissingColumns=True)


def union(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """All records; where a key is in both, the left side's record wins."""
    return upsert(right, left, key)


def delete_keys(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    return subtract(df, keys, key)


def lookup_keys(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """For each asked key whether it is there, and its record if so."""
    return keys.select(key).join(df.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def new_records(source: DataFrame, stored: DataFrame, key: str = KEY) -> DataFrame:
    """Records of the source that the stored dataset does not have."""
    return subtract(source, stored, key)


def apply_changes(stored: DataFrame, changes: DataFrame, key: str = KEY, op: str = "op") -> DataFrame:
    """Apply a change set with one row per key: ``U`` rows replace or add, ``D`` rows delete."""
    upserts = changes.filter(F.col(op) != "D").drop(op)
    return subtract(stored, changes, key).unionByName(upserts.select(*stored.columns))


def first_source_wins(sources: Sequence[DataFrame], order: str | None = None, key: str = KEY) -> DataFrame:
    """Union of sources; of a duplicate key the first source's (and there the first) record is kept.

    Records of one source come in the order of ``order``; without it, and among equals, the smallest path is first,
    then the smallest hash of the record, so the winner never depends on the run.  A rank-limit window is cut before
    the shuffle, so a hot key sends one record per task.  Records without a key are nobody's duplicates: all of them stay.
    """

    def rank(df: DataFrame, i: int) -> DataFrame:
        path = F.col("image_path") if "image_path" in df.columns else F.lit(None).cast("string")
        whole = F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c != key])))
        ranks = {"__source": F.lit(i), "__order": F.col(order) if order else F.lit(0), "__path": path, "__whole": whole}
        return df.withColumns(ranks)

    merged, keyless = rank(sources[0].filter(F.col(key).isNotNull()), 0), sources[0].filter(F.col(key).isNull())
    for i, source in enumerate(sources[1:], start=1):
        merged = merged.unionByName(rank(source.filter(F.col(key).isNotNull()), i), allowMissingColumns=True)
        keyless = keyless.unionByName(source.filter(F.col(key).isNull()), allowMissingColumns=True)
    ranks = ["__source", "__order", "__path", "__whole"]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*ranks))
    return merged.withColumn("__n", first).filter("__n = 1").drop("__n", *ranks).unionByName(keyless)


def cache_override(source: DataFrame, cache: DataFrame, key: str = KEY) -> DataFrame:
    """Take the cached record instead of the source's wherever the cache has the key."""
    fields = [c for c in source.columns if c != key]
    cached = cache.select(key, F.struct(*fields).alias("__cached"))
    row = F.coalesce(F.col("__cached"), F.struct(*fields))
    return source.join(cached, key, "left").select(key, row.alias("__r")).select(key, "__r.*")


def compact_edits(edits: DataFrame, key: str = KEY, seq: str = "seq", op: str = "op") -> DataFrame:
    """Last version per key of an edit log, without the keys whose last edit deletes.

    A rank-limit window cuts before the shuffle, so a key with very many edits sends one row per task.
    """
    last = latest_edits(edits, key, seq)
    return last.filter(F.col(op) != "D").drop(op)


def latest_edits(edits: DataFrame, key: str = KEY, seq: str = "seq") -> DataFrame:
    """Last edit per key, deletions included."""
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return edits.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def index_delta(before: DataFrame, after: DataFrame, tags: str = "tags", key: str = KEY) -> DataFrame:
    """``(tag, key, delta)``: normalised tags that an edit adds (+1) to or removes (-1) from a record."""
    forms = lambda name: F.array_distinct(
        F.coalesce(F.transform(F.col(name), lambda t: normal.underscore_form(t)), F.array().cast("array<string>"))
    )
    old = before.select(key, forms(tags).alias("__old"))
    new = after.select(key, forms(tags).alias("__new"))
    both = old.join(new, key, "full")
    none = F.array().cast("array<string>")
    old_forms, new_forms = F.coalesce("__old", none), F.coalesce("__new", none)
    change = lambda tags_, delta: F.transform(
        tags_, lambda t: F.struct(t.alias("tag"), F.lit(delta).alias("delta"))
    )
    deltas = F.concat(
        change(F.array_except(new_forms, old_forms), 1), change(F.array_except(old_forms, new_forms), -1)
    )
    return explode_rows(both, [key], deltas, "d").select("d.tag", key, "d.delta")
