"""A stored dataset of which a save rewrites only the files that hold changed keys.

Data files hold ranges of keys.  Each version has a table of its files with their smallest and largest key, one row a file.
A changed key belongs to the last file whose smallest key is not greater; only such files are read and written anew, within
their range, and a new version names them beside the untouched ones.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.merge import apply_changes
from . import versions

KEY = "image_key"
_FILES = "folder string, name string, low string, high string, n long"


def _write(df: DataFrame, path: str, key: str, sort: list[str], by: str | None = None, files: int | None = None) -> DataFrame:
    """Write files sorted by key; returns their table."""
    folder = uuid.uuid4().hex
    target, spark = f"{path}/data/{folder}", df.sparkSession
    ranges = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
    writer = ranges.sortWithinPartitions(*sort).write
    (writer.partitionBy(by) if by else writer).parquet(target)
    place = F.regexp_replace(F.col("_metadata.file_path"), rf"\A.*/data/{folder}/", "")
    written = spark.read.option("recursiveFileLookup", "true").schema(df.select(key).schema).parquet(target)
    spans = written.groupBy(place.alias("name")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
    return spans.filter("n > 0").select(F.lit(folder).alias("folder"), "name", "low", "high", "n")


def _commit(spark: SparkSession, path: str, number: int, table: DataFrame, schema: str) -> int:
    name = uuid.uuid4().hex
    table.coalesce(1).write.parquet(f"{path}/files/{name}")
    folders = [r[0] for r in spark.read.schema(_FILES).parquet(f"{path}/files/{name}").select("folder").distinct().collect()]
    return versions.commit(spark, path, number, {"files": name, "folders": folders, "schema": schema})


def file_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(folder, name, low, high, n)`` of a version's data files."""
    number, manifest = versions.current(spark, path, version)
    if not number:
        raise FileNotFoundError(f"nothing is saved in {path}")
    return spark.read.schema(_FILES).parquet(f"{path}/files/{manifest['files']}")


def _read(spark: SparkSession, path: str, schema: str, files: list) -> DataFrame:
    paths = [f"{path}/data/{f['folder']}/{f['name']}" for f in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(df: DataFrame, path: str, key: str = KEY, files: int | None = None) -> int:
    """Store a dataset with unique string keys as version 1; ``path`` must hold none yet.

    Without a number of files Spark's advisory partition size decides how large they are.
    """
    spark = df.sparkSession
    return _commit(spark, path, 1, _write(df, path, key, [key], files=files), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the given one."""
    _, manifest = versions.current(spark, path, version)
    return _read(spark, path, manifest["schema"], file_table(spark, path, version).collect())  # one row a file, as Spark's own listing has


def files_of(spark: SparkSession, lows: list[str]) -> Callable[[Column], Column]:
    """The number of the file that a key belongs to; ``lows`` are the files' smallest keys, sorted."""
    sent = spark.sparkContext.broadcast([x.encode() for x in lows])  # one key a file; bytes sort as Spark's strings

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: max(bisect_right(sent.value, k.encode()) - 1, 0)).astype("int32")

    return number if lows else lambda _: F.lit(0)


def save(spark: SparkSession, path: str, changes: DataFrame, key: str = KEY, op: str = "op") -> int:
    """Apply a change set (one row a key: ``U`` replaces or adds, ``D`` deletes) as a new version; returns its number.

    Files without a changed key stay as they are, name and bytes.  A file that lost all its records is dropped; one with
    many more is split.  Until the version is committed readers see the old one, also if the save breaks off; a save that
    another one has overtaken raises ``versions.Conflict``.  Changes without a key are refused.
    """
    number, manifest = versions.current(spark, path)
    files = sorted(file_table(spark, path).collect(), key=lambda f: f["low"].encode())
    checked = changes.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("a change has no key"))).otherwise(F.col(key)))
    file_of = files_of(spark, [f["low"] for f in files])
    touched = {r[0] for r in checked.select(file_of(F.col(key))).distinct().collect()}  # at most one row a file
    if not touched:
        return number
    old = _read(spark, path, manifest["schema"], [f for i, f in enumerate(files) if i in touched])
    new = apply_changes(old, checked, key, op).withColumn("__file", file_of(F.col(key)))
    written = _write(new, path, key, ["__file", key], "__file")
    kept = spark.createDataFrame([f for i, f in enumerate(files) if i not in touched], _FILES)
    return _commit(spark, path, number + 1, kept.union(written), manifest["schema"])


def forget(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete versions but the newest ``keep`` and the folders of files that none of these needs."""
    versions.forget(spark, path, keep, "data")
