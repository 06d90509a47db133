"""Path-derived columns and path rewrites."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; dot-files keep their full name."""
    return F.regexp_extract(name(path), r"\A(.+?)(\.[^.]+)?\z", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"\A.+?(\.[^.]+)\z", 1)


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def category(path: Column) -> Column:
    """Name of the parent directory."""
    return name(_parent(path))


def source(path: Column) -> Column:
    """Path of the grandparent directory."""
    return _parent(_parent(path))


def root(path: Column) -> Column:
    return _parent(source(path))


def with_name(path: Column, new: Column) -> Column:
    return F.concat(_parent(path), F.lit("/"), new)


def with_suffix(path: Column, new: str) -> Column:
    return with_name(path, F.concat(stem(path), F.lit(new)))


def label_path(path: Column) -> Column:
    """Where the sidecar caption of the record lives."""
    return with_suffix(path, ".txt")


def change_source(path: Column, new_source: str) -> Column:
    """Replace the grandparent directory's name."""
    return F.concat(root(path), F.lit("/" + new_source + "/"), category(path), F.lit("/"), name(path))


def change_category(path: Column, new_category: Column | str) -> Column:
    """Replace the parent directory's name."""
    new = F.lit(new_category) if isinstance(new_category, str) else new_category
    return F.concat(source(path), F.lit("/"), new, F.lit("/"), name(path))
