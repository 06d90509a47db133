"""Named sort keys and record sorting.

``orderBy`` range-partitions on sampled bounds, so a full sort has no single task; a report of the first rows is
``orderBy`` + ``limit``, which Spark runs as a merged top-n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, hashes, paths, tags as tg
from ..functions.rules import SAFE_LEVELS
from .ordinal import row_index


def _or_low(value: Column) -> Column:
    """Missing values sort below everything."""
    return F.coalesce(value.cast("double"), F.lit(float("-inf")))


def _safe_level(df_col: Callable[[str], Column]) -> Column:
    chain = None
    for level, number in SAFE_LEVELS.items():
        hit = df_col("safe_level") == level
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain.otherwise(len(SAFE_LEVELS))


def hash_distance(target: str | None) -> Column:
    """Distance of ``perceptual_hash`` to a target hash; a missing hash or target is infinitely far."""
    if target is None:
        return F.lit(float("inf"))
    mine, other = hashes.halves(F.col("perceptual_hash")), hashes.halves(F.lit(target))
    distance = hashes.hamming(mine["h1"], mine["h2"], other["h1"], other["h2"])
    return F.coalesce(distance.cast("double"), F.lit(float("inf")))


def sort_key(method: str, target: str | None = None, seed: int = 0) -> Column:
    """The Column a named method sorts by."""
    path, size, tags = F.col("image_path"), F.col("original_size"), F.col("tags")
    area = size["width"].cast("double") * size["height"]
    ratio = F.when(size["height"] != 0, size["width"] / size["height"])
    score = F.col("aesthetic_score")
    methods: dict[str, Callable[[], Column]] = {
        "key": lambda: F.col("image_key"),
        "stem": lambda: paths.stem(path),
        "extension": lambda: paths.suffix(path),
        "category": lambda: paths.category(path),
        "perceptual_hash": lambda: hash_distance(target),
        "aesthetic_score": lambda: _or_low(score),
        "original_size": lambda: _or_low(area),
        "original_width": lambda: _or_low(size["width"]),
        "original_height": lambda: _or_low(size["height"]),
        "original_aspect_ratio": lambda: _or_low(ratio),
        "caption_length": lambda: _or_low(tg.length(tags)),
        "has_gen_info": lambda: F.coalesce(F.size("gen_info") > 0, F.lit(False)),
        "quality": lambda: dv.quality_number(tags),
        "quality_or_score": lambda: F.coalesce(score, dv.quality_number(tags)),
        "random": lambda: F.md5(F.concat(F.lit(f"{seed}:"), F.col("image_key"))),
        "safe_rating": lambda: _or_low(F.col("safe_rating")),
        "safe_level": lambda: _safe_level(F.col),
    }
    if method not in methods:
        raise KeyError(f"unknown sort method {method!r}")
    return methods[method]()


def sort_order(
    methods: Sequence[str], reverse: bool = False, tie: str = "ord", target: str | None = None, seed: int = 0
) -> list[Column]:
    """Sort columns for several methods with one shared direction; ties stay in ``tie`` order either way."""
    keys = [sort_key(m, target, seed) for m in methods]
    return [k.desc() if reverse else k.asc() for k in keys] + [F.col(tie).asc()]


def sort_records(df: DataFrame, methods: Sequence[str], reverse: bool = False, **options) -> DataFrame:
    return df.orderBy(*sort_order(methods, reverse, **options))


def rank_records(
    df: DataFrame, methods: Sequence[str], reverse: bool = False, tie: str = "ord", key: str = "image_key", **options
) -> DataFrame:
    """``(key, row_index, total)`` of every record in the named order; each sort key is computed once."""
    names = [f"k{i}" for i in range(len(methods))]
    keyed = df.select(key, tie, *[sort_key(m, **options).alias(n) for m, n in zip(methods, names)])
    order = [F.col(n).desc() if reverse else F.col(n).asc() for n in names] + [F.col(tie).asc()]
    return row_index(keyed, order, key)
