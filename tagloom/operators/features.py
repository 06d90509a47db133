"""Removal of character features as one chain: statistics of the captions, a feature table, edited captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from .dictionary import defeature
from .stats import Patterns, character_features


def feature_statistics(df: DataFrame, retype: Callable[[DataFrame], DataFrame], patterns: Patterns) -> DataFrame:
    """``(character, feature, cnt, freq)`` of the captions, written once, for several thresholds."""
    return materialise(character_features(df, retype, patterns), "feature-statistics")


def remove_character_features(
    df: DataFrame,
    retype: Callable[[DataFrame], DataFrame],
    patterns: Patterns,
    freq_threshold: float = 0.3,
    count_threshold: int = 1,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Records without the tags that their characters' captions usually hold.

    A tag is a feature of a character if it matches ``patterns`` and stands in at least ``count_threshold`` captions of the
    character and in a share of ``freq_threshold`` of them.  ``retype`` adds the ``typed`` column, ``characters`` are those
    of the records.  ``statistics`` of an earlier run, or of another dataset, can be given instead of this one's.
    """
    known = feature_statistics(df, retype, patterns) if statistics is None else statistics
    usual = known.filter((F.col("freq") >= freq_threshold) & (F.col("cnt") >= count_threshold)).select("character", "feature")
    return defeature(df, usual)
