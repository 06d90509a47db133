"""Pages from a stored order: records sorted into files once, and a directory of the row numbers that each file holds."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import versions

_DIRECTORY = "name string, first long, n long"
_ROW = "__place"


def write_order(df: DataFrame, order: Sequence[Column | str], path: str, files: int | None = None) -> int:
    """Store the records in an order, which should be total, as the newest version; returns the number of files.

    Every file is one range of the order, as large as Spark's advisory partition size unless ``files`` says how many.  The directory has a row a file: its first row number and its number of rows.
    """
    spark, folder = df.sparkSession, uuid.uuid4().hex
    number, _ = versions.current(spark, path)
    target = f"{path}/data/{folder}"
    ranges = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    sorted_rows = ranges.sortWithinPartitions(*order).withColumn(_ROW, F.monotonically_increasing_id())
    sorted_rows.write.option("maxRecordsPerFile", 0).parquet(target)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\z", 1)
    counted = spark.read.schema(f"{_ROW} long").parquet(target).groupBy(name.alias("name")).agg(F.min(_ROW).alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    directory = counted.select("name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n", "low")
    listed = f"{path}/directories/{folder}"
    directory.coalesce(1).write.parquet(listed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    versions.commit(spark, path, number + 1, {"folders": [folder], "schema": schema})
    return spark.read.parquet(listed).count()


def _files(spark: SparkSession, path: str) -> tuple[dict, str, DataFrame]:
    number, manifest = versions.current(spark, path)
    if not number:
        raise FileNotFoundError(f"no order is stored in {path}")
    folder = manifest["folders"][0]
    return manifest, f"{path}/data/{folder}", spark.read.schema(_DIRECTORY + ", low long").parquet(f"{path}/directories/{folder}")


def total(spark: SparkSession, path: str) -> int:
    """Number of rows of the stored order, from its directory."""
    return _files(spark, path)[2].agg(F.sum("n")).first()[0] or 0


def read_page(spark: SparkSession, path: str, index: int, size: int) -> DataFrame:
    """One page (0-based), in order, from the files that hold its rows; an index out of range is empty.

    Rows of a file are found by their place in it, which the scan's own statistics prune.
    """
    manifest, data, directory = _files(spark, path)
    start, stop = index * size, (index + 1) * size
    held = directory.filter((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).orderBy("first").collect() if index >= 0 else []  # at most ``size`` files
    if not held:
        return spark.createDataFrame([], manifest["schema"])
    ranges = [(f["low"] + max(start - f["first"], 0), f["low"] + min(stop - f["first"], f["n"]), f["name"]) for f in held]
    rows = spark.read.schema(f"{manifest['schema']}, {_ROW} long").parquet(*[f"{data}/{name}" for *_, name in ranges])
    low, high = ranges[0][0], ranges[-1][1]
    return rows.filter((F.col(_ROW) >= low) & (F.col(_ROW) < high)).orderBy(_ROW).drop(_ROW)
