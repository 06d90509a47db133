"""Session helpers: where durable intermediate results go, and size-checked inlining of small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The durable shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="tagloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tagloom/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete everything this driver has put below the shared folder; call it when no result that reads it is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The result is computed once, does not depend on shuffle files of lost executors, and values that are only
    stable within one evaluation (partition ids) are fixed.  The copy stays until ``release_scratch``.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def explode_rows(df: DataFrame, keep: Sequence[Column | str], items: Column, *names: str, position: bool = False) -> DataFrame:
    """``explode`` (or ``posexplode``) of a computed array or map without null elements.

    For a plain ``explode`` Spark infers size and null filters on the generated array and pushes copies of its
    whole expression below.  The outer form has no such filters; the rows of empty lists are dropped afterwards.
    """
    generate = F.posexplode_outer if position else F.explode_outer
    return df.select(*keep, generate(items).alias(*names)).filter(F.col(names[0]).isNotNull())


def gather(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Bring the few rows of each record together: shuffle first, then aggregate once.

    Lists do not shrink map-side, so a partial aggregate before the shuffle would only add a sort per task.
    """
    return df.repartition(key).groupBy(key).agg(*aggregates)


def collect_if_small(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows if there are at most ``limit``, else None; never more than ``limit + 1`` rows reach the driver."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows
