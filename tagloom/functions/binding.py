"""Evaluate an expression once and mention it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    Higher-order functions evaluate an outer expression for every element and every mention, and a filter pushed
    below a projection copies the projected expression; a bound value is computed once in both cases.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
