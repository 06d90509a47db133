"""Sinks.  Append means upsert: the stored dataset is read, merged and written to a new place."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import paths, tags as tg
from ..operators.merge import subtract, upsert
from ..operators.records import tabular
from ..schema import RECORD

MANIFEST = "image_key string, label_path string, bytes bigint, status string"


def _with_stored(df: DataFrame, stored: DataFrame | None) -> DataFrame:
    return df if stored is None else upsert(stored.select(*df.columns), df)


def _size_text(df: DataFrame) -> DataFrame:
    if dict(df.dtypes).get("original_size", "string") == "string":
        return df
    size = F.col("original_size")
    text = F.format_string("(%d, %d)", size["width"], size["height"])
    return df.withColumn("original_size", F.when(size.isNotNull(), text))


def write_records(df: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Native sink: Parquet, optionally merged over a stored dataset.  ``path`` must be new."""
    _with_stored(df, stored).write.parquet(path)


def write_json(df: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """One JSON record per line, attributes in tabular order; ``path`` must be new."""
    _with_stored(tabular(df), stored).write.option("ignoreNullFields", "false").json(path)


def record_json(df: DataFrame) -> DataFrame:
    """Records as texts ``{key: record}``, one object per record."""
    view = tabular(df)
    body = F.struct(*[F.col(c) for c in view.columns if c != "image_key"])
    return view.select(
        F.to_json(F.create_map("image_key", body), {"ignoreNullFields": "false"}).alias("value")
    )


def write_record_json(df: DataFrame, path: str) -> None:
    """One object ``{key: record}`` on a line, to be read by ``read_record_json`` with no indent; ``path`` must be new."""
    record_json(df).write.text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", stored: DataFrame | None = None) -> None:
    """CSV in tabular order with a header in every part file; ``path`` must be new."""
    view = _with_stored(_size_text(tabular(df)), None if stored is None else _size_text(stored))
    view.write.option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", True).option(
        "emptyValue", '""'
    ).csv(path)


def label_check(df: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """What a text export will meet: ``(image_key, missing_image, overwrites_label)`` from two listings."""
    there = images.select("image_path").distinct().withColumn("__image", F.lit(True))
    old = labels.select("label_path").distinct().withColumn("__label", F.lit(True))
    return (
        df.select("image_key", "image_path", paths.label_path(F.col("image_path")).alias("label_path"))
        .join(there, "image_path", "left")
        .join(old, "label_path", "left")
        .select(
            "image_key",
            F.col("__image").isNull().alias("missing_image"),
            F.coalesce("__label", F.lit(False)).alias("overwrites_label"),
        )
    )


def write_index(index: DataFrame, path: str, key: str = "image_key") -> None:
    """Store an inverted index so that a search reads few row groups.

    Rows are range partitioned by tag and key, so a hot tag spreads over several files.
    """
    index.repartitionByRange("tag", key).sortWithinPartitions("tag", key).write.parquet(path)


def _fill(path: str, text: str, flags: int) -> None:
    """Write a file by plain system calls: with very many short files ``pathlib`` takes longer than the files do."""
    data = text.encode("utf-8")
    file = os.open(path, os.O_WRONLY | flags, 0o666)
    try:
        done = 0
        while done < len(data):
            done += os.write(file, data[done:])
        if os.fstat(file).st_size > len(data):
            os.ftruncate(file, len(data))
    finally:
        os.close(file)


def mounted_text(path: str, text: str) -> None:
    """Write a text on a file system that all executors mount; paths with a scheme are refused."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"{path} is no mounted path; give a put function for its file system")
    try:
        _fill(path, text, os.O_CREAT | os.O_TRUNC)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        _fill(path, text, os.O_CREAT | os.O_TRUNC)


def mounted_reuse(spare: str, path: str, text: str) -> bool:
    """Give a file that is no longer needed another path and a text; False if that can't be, without a file at ``spare`` either way.

    A new path and the loss of the old one are steps that only one task can take, so no two paths share a file.
    """
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"{path} is no mounted path; give a put function for its file system")
    try:
        try:
            os.link(spare, path)
        except FileNotFoundError:  # no such folder, or no such spare file
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            os.link(spare, path)
    except OSError:  # a file is there, the spare one is gone, or the file system has no links
        mounted_removal(spare)
        return False
    try:
        os.unlink(spare)
    except FileNotFoundError:  # another attempt of this task has taken it
        os.unlink(path)
        return False
    _fill(path, text, 0)
    return True


class Spares(NamedTuple):
    """Files ``(path)`` that are no longer needed: ``take(spare, path, text)`` makes one of them a new file, ``remove`` ends one."""

    files: DataFrame
    take: Callable[[str, str, str], bool]
    remove: Callable[[str], None]


def _written(df: DataFrame, path: str, put: Callable[[str, str], None], spares: Spares | None, schema: str) -> DataFrame:
    """Rows of ``df``, which has a ``text`` for every ``path``, after their files were written, from spare files as long as a task has some."""
    take = remove = None
    if spares is not None:
        take, remove, none = spares.take, spares.remove, [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        rows = df.withColumn("__spare", F.lit(None).cast("string")).union(spares.files.select(*none, F.col("path").alias("__spare")))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = rows.repartition(tasks).sortWithinPartitions(F.col("__spare").isNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = []
        for frame in frames:
            if take is not None:
                spare = frame["__spare"].notna()
                left.extend(frame.loc[spare, "__spare"])
                frame = frame[~spare].drop(columns="__spare")
            for where, text in zip(frame[path], frame["text"]):
                if not (left and take(left.pop(), where, text)):
                    put(where, text)
            yield frame.drop(columns="text").assign(bytes=frame["text"].str.encode("utf-8").str.len(), status="written")[names]
        for where in left:
            remove(where)

    names = [field.split()[0] for field in schema.split(", ")]
    return df.mapInPandas(run, schema)


def write_texts(df: DataFrame, put: Callable[[str, str], None], spares: Spares | None = None) -> DataFrame:
    """Write the texts of ``df(path, text)`` in the tasks; returns the lazy manifest ``(path, bytes)``.

    With ``spares`` files that are no longer needed become the new ones, and none of them is left.
    """
    return _written(df.select("path", "text"), "path", put, spares, "path string, bytes bigint")


def mounted_removal(path: str) -> None:
    """Remove a file of a file system that all executors mount, if it is there; paths with a scheme are refused."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"{path} is no mounted path; give a removal function for its file system")
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def remove_texts(manifest: DataFrame, remove: Callable[[str], None]) -> int:
    """Remove the files of a stored manifest ``(path)`` in the tasks; how many rows it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                remove(path)
            yield pd.DataFrame({"n": [len(frame)]})

    tasks = min(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // 1000))
    return manifest.select("path").repartition(max(1, tasks)).mapInPandas(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0


def write_captions(df: DataFrame, put: Callable[[str, str], None], spares: Spares | None = None) -> DataFrame:
    """Write one text file per record with a non-empty caption; returns a lazy manifest.

    ``put(path, text)`` runs on executors and decides where files go: ``mounted_text``, or a function for another file
    system.  Rows say ``written`` after their file was.  A retried task rewrites the same files with the same content.
    ``spares`` are as in ``write_texts``.
    """
    todo = df.filter(F.size("tags") > 0).select(
        "image_key", paths.label_path(F.col("image_path")).alias("label_path"), tg.render(F.col("tags")).alias("text")
    )
    return _written(todo, "label_path", put, spares, MANIFEST)


def save_changes(stored: DataFrame, changes: DataFrame, path: str) -> None:
    """Buffered save: apply a change set to the stored dataset and write the result to a new place."""
    from ..operators.merge import apply_changes

    apply_changes(stored, changes).write.parquet(path)


def pending(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records a restarted text export still has to write."""
    return subtract(records, manifest)


__all__ = [
    "RECORD",
    "Spares",
    "label_check",
    "pending",
    "record_json",
    "save_changes",
    "mounted_removal",
    "mounted_reuse",
    "mounted_text",
    "remove_texts",
    "write_captions",
    "write_record_json",
    "write_csv",
    "write_index",
    "write_json",
    "write_records",
    "write_texts",
]
