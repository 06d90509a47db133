"""Versions of a stored dataset: small manifests that appear at once or not at all.

A folder holds data files, which are never changed, and ``_versions/<number>``, one small text a version that says which
files are meant.  A version is written under another name and renamed to its number, so readers see all of it or nothing,
and a second writer of the same number fails.  Works on any file system that Spark reaches.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text that appears at once; False if there is one already, which is left as it is."""
    target, system = _path(spark, path)
    if system.exists(target):
        return False
    parent = target.getParent()
    system.mkdirs(parent)
    draft, _ = _path(spark, f"{parent.toString()}/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(text.encode("utf-8"))
    stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    keep_old = spark.sparkContext._gateway.new_array(rename, 1)
    keep_old[0] = rename.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, keep_old)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def get(spark: SparkSession, path: str) -> str | None:
    target, system = _path(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder that are not hidden, sorted; none if there is no such folder."""
    target, system = _path(spark, folder)
    if not system.exists(target):
        return []
    found = (s.getPath().getName() for s in system.listStatus(target))
    return sorted(n for n in found if not n.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in names(spark, f"{path}/_versions") if n.isdigit()]


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """``(number, manifest)`` of the newest version, or of the given one; number 0 and nothing if there is none."""
    known = versions(spark, path)
    number = max(known, default=0) if version is None else version
    if number == 0:
        return 0, {}
    if number not in known:
        raise FileNotFoundError(f"{path} has no version {number}")
    return number, json.loads(get(spark, f"{path}/_versions/{number:010d}"))


def commit(spark: SparkSession, path: str, number: int, manifest: dict) -> int:
    """Make a manifest the version ``number``, the one after what the writer has read."""
    if not put_new(spark, f"{path}/_versions/{number:010d}", json.dumps(manifest)):
        raise Conflict(f"{path} has a version {number} already")
    return number


def forget(spark: SparkSession, path: str, keep: int, folders: str) -> None:
    """Drop all versions but the newest ``keep``, and of the entries below ``folders`` those that no version left names.

    A manifest names what it needs in ``"folders"``.  Run it when no writer is at work and nobody reads an older version.
    """
    numbers = versions(spark, path)
    left = numbers[-keep:] if keep else []
    needed = {f for n in left for f in current(spark, path, n)[1]["folders"]}
    for number in numbers[: len(numbers) - len(left)]:
        remove(spark, f"{path}/_versions/{number:010d}")
    for name in names(spark, f"{path}/{folders}"):
        if name not in needed:
            remove(spark, f"{path}/{folders}/{name}")
