"""A stored inverted index that takes edits as sorted runs beside a base.

The base holds ``(tag, key)``; a run holds ``(tag, key, present)`` for what one round of edits changed, ``present`` false
where a key left a tag.  The newest run that mentions a pair decides.  All are sorted by tag and key, so a search reads
the row groups of its tags only, in the base and in the runs.  Compaction merges runs into one, or everything into a base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import versions

KEY = "image_key"


def _ranged(df: DataFrame, key: str) -> DataFrame:
    return df.repartitionByRange("tag", key)


def _sorted_write(df: DataFrame, path: str, key: str) -> str:
    """Store rows that ``_ranged`` has dealt out."""
    name = uuid.uuid4().hex
    df.sortWithinPartitions("tag", key).write.parquet(f"{path}/runs/{name}")
    return name


def _commit(spark: SparkSession, path: str, number: int, base: str, runs: list[str]) -> int:
    return versions.commit(spark, path, number, {"base": base, "runs": runs, "folders": [base, *runs]})


def create(index: DataFrame, path: str, key: str = KEY) -> int:
    """Store an index as a base without runs."""
    return _commit(index.sparkSession, path, 1, _sorted_write(_ranged(index.select("tag", key).distinct(), key), path, key), [])


def add_run(path: str, delta: DataFrame, key: str = KEY) -> int:
    """Add the changes ``(tag, key, delta)`` of ``operators.merge.index_delta`` as the newest run.

    Positive sums add a pair, negative ones remove it, and what cancels out is left out.
    """
    spark = delta.sparkSession
    number, manifest = versions.current(spark, path)
    net = delta.groupBy("tag", key).agg(F.sum("delta").alias("__net")).filter("__net != 0").select("tag", key, (F.col("__net") > 0).alias("present"))
    return _commit(spark, path, number + 1, manifest["base"], [*manifest["runs"], _sorted_write(_ranged(net, key), path, key)])


def _runs(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows ``(tag, key, present, __run)`` of these runs, numbered from the oldest."""
    runs = [spark.read.parquet(f"{path}/runs/{n}").withColumn("__run", F.lit(i)) for i, n in enumerate(names)]
    every = runs[0]
    for run in runs[1:]:
        every = every.union(run)
    return every


def _with_base(spark: SparkSession, path: str, manifest: dict, key: str) -> DataFrame:
    """The rows of the base as those of a run older than all, and the rows of the runs."""
    base = spark.read.parquet(f"{path}/runs/{manifest['base']}").select("tag", key, F.lit(True).alias("present"), F.lit(-1).alias("__run"))
    return base.union(_runs(spark, path, manifest["runs"]))


def _newest(every: DataFrame, key: str) -> DataFrame:
    """``(tag, key, present)`` as the newest run has it."""
    return every.groupBy("tag", key).agg(F.max_by("present", "__run").alias("present"))


def _current(every: DataFrame, key: str) -> DataFrame:
    """The pairs ``(tag, key)`` that base and runs come to, in one aggregate.

    A pair without tag or key equals none: the base's stay, whatever runs say, and a run's come beside them.
    """
    newest = F.max_by("present", "__run")
    pairs = every.groupBy("tag", key).agg(newest.alias("__present"), F.max("__run").alias("__last"), F.count_if(F.col("__run") == -1).alias("__base"))
    added = F.when((F.col("__last") >= 0) & F.col("__present"), 1).otherwise(0)
    odd = F.col("tag").isNull() | F.col(key).isNull()
    copies = F.when(odd, F.col("__base") + added).when(F.col("__last") >= 0, added).otherwise(F.col("__base")).cast("int")
    return pairs.select("tag", key, F.explode(F.array_repeat(F.lit(True), copies))).select("tag", key)


def load(spark: SparkSession, path: str, version: int | None = None, key: str = KEY) -> DataFrame:
    """The current ``(tag, key)``; a filter on ``tag`` reaches the scans of the base and of every run."""
    _, manifest = versions.current(spark, path, version)
    if not manifest["runs"]:
        return spark.read.parquet(f"{path}/runs/{manifest['base']}")
    return _current(_with_base(spark, path, manifest, key), key)


def compact(spark: SparkSession, path: str, whole: bool = True, key: str = KEY) -> int:
    """Merge base and runs into a new base, or (``whole=False``) the runs into one run, as a new version.

    Stored rows are dealt out by range first: the ranges come from a scan, and what is equal is together for the aggregate.
    """
    number, manifest = versions.current(spark, path)
    if not manifest["runs"] or (not whole and len(manifest["runs"]) == 1):
        return number
    if whole:
        pairs = _current(_ranged(_with_base(spark, path, manifest, key), key), key)
        return _commit(spark, path, number + 1, _sorted_write(pairs, path, key), [])
    merged = _newest(_ranged(_runs(spark, path, manifest["runs"]), key), key)
    return _commit(spark, path, number + 1, manifest["base"], [_sorted_write(merged, path, key)])


def forget(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete versions but the newest ``keep`` and the runs that none of these needs."""
    versions.forget(spark, path, keep, "runs")
