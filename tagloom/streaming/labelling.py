"""A labelling job that saves after every few files of its source and can be stopped at any time.

The source is a folder of record files, read as a stream in batches.  Each batch's labels are written to a folder of their
own, and a commit record ``_commits/<batch>`` then says which folder counts.  A batch that is run again, because the job
died between its commit and the stream's own note of progress, finds the record and writes nothing; folders without a
record (an attempt that broke off) are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from ..sources import versions


class _Enough(Exception):
    """The batch after the last one that this run may save."""


def committed(spark: SparkSession, output: str) -> dict[int, str]:
    """The folder that counts, by batch."""
    return {int(n): json.loads(versions.get(spark, f"{output}/_commits/{n}"))["folder"] for n in versions.names(spark, f"{output}/_commits") if n.isdigit()}


def labelled(spark: SparkSession, output: str, schema: T.StructType | str) -> DataFrame:
    """All labels saved so far."""
    folders = [f"{output}/labels/{f}" for f in committed(spark, output).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def save_batch(batch: DataFrame, number: int, output: str, label: Callable[[DataFrame], DataFrame]) -> bool:
    """Label and save one batch unless it is committed already; whether this call's labels count."""
    spark, record = batch.sparkSession, f"{output}/_commits/{number:010d}"
    if versions.get(spark, record) is not None:
        return False
    folder = f"{number:010d}-{uuid.uuid4().hex}"
    label(batch).write.parquet(f"{output}/labels/{folder}")
    return versions.put_new(spark, record, json.dumps({"folder": folder}))


def label_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    label: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    files_per_save: int = 100,
    most_saves: int | None = None,
) -> int:
    """Label the Parquet records below ``source`` that earlier runs have not; returns the batches saved by this run.

    ``label`` is given a static DataFrame of at most ``files_per_save`` files; its model runs in the tasks
    (``operators.batch.run_model``).  ``checkpoint`` and ``output`` have to outlive the job; a run with the same two goes on
    where the last one stopped, also if that failed within a batch.  ``most_saves`` ends a run early.  Errors of the model
    end the run and are raised; what was committed stays.
    """
    saved, stopped = 0, False

    def each(batch: DataFrame, number: int) -> None:
        nonlocal saved, stopped
        if most_saves is not None and saved >= most_saves:
            stopped = True
            raise _Enough
        saved += save_batch(batch, number, output, label)

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_save).parquet(source)
        .writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    except Exception:
        if not stopped:
            raise
    return saved
