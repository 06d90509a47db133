"""Edits and labelling on Structured Streaming sources.

The tag functions and named edits are narrow selects, so they run on a stream as they are.  There is no stateful
operator here, because nothing in the feature set needs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import edit


def edit_stream(stream: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Apply named edits in order to a streaming (or static) DataFrame."""
    for name, options in steps:
        stream = edit(stream, name, **options)
    return stream


def label_new_files(
    stream: DataFrame, label: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Labelling job over arriving records: labels what is new, appends to Parquet and stops when caught up.

    Progress is saved per micro-batch in the folder ``checkpoint``, which has to outlive the job: a restart with the same
    folder goes on where it stopped.
    """
    return (
        label(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
