"""Distributed row numbers, pages, splits, batches and samples.

No operator here sends all rows through one task.  Positions come from range-sorted or hash-bucketed partitions
plus the running total of per-partition counts, a table with one row per partition or bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialise

KEY = "image_key"
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits

#: Above this many rows a sample or page is taken by row number instead of a merged top-n.
TOP_N_LIMIT = 100_000


def _with_offsets(counts: DataFrame, by: str) -> DataFrame:
    """Add the number of rows before each bucket and the total; one row per bucket, so one task is enough."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        by,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"),
        F.sum("n").over(everything).alias("total"),
    )


def row_index(df: DataFrame, order: Sequence[Column | str], key: str = KEY) -> DataFrame:
    """``(key, row_index, total)``: 0-based position of every record in the given order.

    The order must be total (end it with a unique column), so equal sort keys still spread over partitions.
    Column pruning leaves only the key and the order columns in the exchange; the numbered result is written once,
    because partition numbers are only stable within one evaluation.  The broadcast side has one row per partition.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(key, F.monotonically_increasing_id().alias("__id"))
    )
    fixed = materialise(numbered, "row-index").select(
        key,
        F.shiftright("__id", _OFFSET_BITS).alias("__part"),
        F.col("__id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias("__pos"),
    )
    offsets = _with_offsets(fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")), "__part")
    return fixed.join(F.broadcast(offsets), "__part").select(
        key, (F.col("__before") + F.col("__pos")).alias("row_index"), "total"
    )


def shuffled_index(df: DataFrame, seed: int = 0, key: str = KEY, digits: int = 3) -> DataFrame:
    """``(key, row_index, total)`` in a reproducible random order: by the MD5 of seed and key.

    The first hex digits of the hash are the bucket, so buckets are even whatever the keys look like and the
    plan needs no written intermediate.  ``16 ** digits`` bounds the table of offsets.
    """
    hashed = df.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))).alias("__hash")).withColumn(
        "__bucket", F.substring("__hash", 1, digits)
    )
    offsets = _with_offsets(hashed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")), "__bucket")
    position = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", key)) - 1
    return (
        hashed.withColumn("__pos", position)
        .join(F.broadcast(offsets), "__bucket")
        .select(key, (F.col("__before") + F.col("__pos")).alias("row_index"), "total")
    )


# -- pages --------------------------------------------------------------------------------------------


def page(
    df: DataFrame, order: Sequence[Column | str], index: int, size: int, key: str = KEY, merged: int | None = None
) -> DataFrame:
    """One fixed-size page (0-based), in order; an index out of range is empty.

    Pages that end within the first ``merged`` rows are a merged top-n; deeper ones pick keys by row number and are
    ordered by it.  Keys must be unique.
    """
    if index < 0:
        return df.limit(0)
    if (index + 1) * size <= (TOP_N_LIMIT if merged is None else merged):
        return df.orderBy(*order).offset(index * size).limit(size)
    wanted = row_index(df, order, key).filter(
        (F.col("row_index") >= index * size) & (F.col("row_index") < (index + 1) * size)
    )
    return _in_order(df, wanted, key)


def _in_order(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The records of some index rows, in the order of the index."""
    found = df.join(chosen.select(key, F.col("row_index").alias("__row")), key)
    return found.orderBy("__row").select(*df.columns)


def page_numbers(index: DataFrame, size: int) -> DataFrame:
    """Page of every record and the page count, from a row index."""
    return index.select(
        "*",
        F.floor(F.col("row_index") / size).alias("page"),
        F.ceil(F.col("total") / size).alias("num_pages"),
    )


# -- splits --------------------------------------------------------------------------------------------


def split_by_ratio(index: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """Add ``part``: boundaries are ``int(cumulative ratio * total)``, the last part takes the rest."""
    part = None
    for i in range(len(ratios) - 1):
        bound = sum(ratios[: i + 1]) / sum(ratios)
        below = F.col("row_index") < F.floor(F.lit(bound) * F.col("total"))
        part = F.when(below, i) if part is None else part.when(below, i)
    last = len(ratios) - 1
    return index.withColumn("part", F.lit(last) if part is None else part.otherwise(last))


def split_in_n(index: DataFrame, n: int) -> DataFrame:
    """Add ``part`` with stride ``ceil(total / n)``; there may be fewer than ``n`` parts."""
    stride = F.ceil(F.col("total") / n)
    return index.withColumn("part", F.floor(F.col("row_index") / stride))


def batches(index: DataFrame, size: int) -> DataFrame:
    return index.withColumn("batch_id", F.floor(F.col("row_index") / size))


# -- samples -------------------------------------------------------------------------------------------


def head(df: DataFrame, n: int, order: Sequence[Column | str], condition: Column | None = None, key: str = KEY) -> DataFrame:
    """The first ``n`` records in order that meet the condition."""
    scope = df if condition is None else df.filter(condition)
    return page(scope, order, 0, n, key)


def sample(
    df: DataFrame, n: int, seed: int = 0, condition: Column | None = None, key: str = KEY, merged: int | None = None
) -> DataFrame:
    """``n`` records in reproducible random order; fewer if fewer meet the condition."""
    scope = df if condition is None else df.filter(condition)
    if n <= (TOP_N_LIMIT if merged is None else merged):
        order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
        return scope.orderBy(order, key).limit(n)
    chosen = shuffled_index(scope, seed, key).filter(F.col("row_index") < n)
    return _in_order(scope, chosen, key)


def sample_unseen(df: DataFrame, history: DataFrame, n: int, seed: int = 0, key: str = KEY) -> DataFrame:
    """A sample of records whose keys are not in the history yet."""
    return sample(df.join(history.select(key), key, "left_anti"), n, seed, key=key)


def cap_per_group(
    df: DataFrame, group: str, order: Sequence[Column | str], limit: int, existing: DataFrame | None = None
) -> DataFrame:
    """Keep the first ``limit - already_exist`` records of each group; ``existing(group, already_exist)``.

    Groups are cut in three steps, with as many salts as shuffle partitions, with their square root, and whole.  So the
    last task of a hot group gets at most ``limit`` rows for each of the few salts of the step before, whatever the
    group's size, and the plan is the same for every limit.  The salt is a hash of the record's key, or without one of all
    columns that can be hashed.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [KEY] if KEY in df.columns else [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    kept = df.withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.lit(width)))
    for salts in (width, ceil(width**0.5), 1):
        part = [group] if salts == 1 else [group, F.col("__salt") % salts]
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        kept = kept.withColumn("__rank", rank).filter(F.col("__rank") <= limit)
    kept = kept.drop("__salt")
    if existing is not None:
        kept = kept.join(existing.select(group, "already_exist"), group, "left").filter(
            F.col("__rank") <= limit - F.coalesce("already_exist", F.lit(0))
        ).drop("already_exist")
    return kept.drop("__rank")
