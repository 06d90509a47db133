"""Joins with a table of unique keys in which a few keys hold most rows.

Heavy keys are found by a sketch of frequent items of fixed size, in one pass.  Their rows stay where they are: the table's
entries for them, no more than the sketch names, are broadcast.  Rows without a key stay as well.  All others are shuffled,
and none of their keys is heavy.  So the tasks are even without relying on skew handling at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys looked for, items that the sketch tracks, and the part of all rows from which a key is heavy.
KEYS, TRACKED, SHARE = 256, 8192, 1 / 1000


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> list:
    """At most ``KEYS`` keys that hold ``share`` of the rows or more; the sketch may miss rare ones, never the most frequent."""
    found = rows.select(key).agg(F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {KEYS}, {TRACKED})").alias("top")).first()
    return [t["item"] for t in found["top"] or [] if t["item"] is not None and t["count"] >= max(share * found["n"], 2)]


def join_heavy(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: float = SHARE) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``, whose keys are unique and not null.

    ``rows`` are read twice, once for the key column only.  The result is that of a plain join.
    """
    heavy = heavy_keys(rows, key, share)
    named = F.col(key).isin(heavy)
    stay = named | F.col(key).isNull()
    hot = rows.filter(stay).join(F.broadcast(table.filter(named)), key, how)  # at most KEYS rows of the table
    return hot.unionByName(rows.filter(~stay).join(table, key, how))
