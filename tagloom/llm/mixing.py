"""Mixing of sources to target token shares by entropy balancing.

Document rates are the ones closest to 1 in relative entropy that meet a token constraint for every source, with no rate
above ``cap``.  The solution is an exponential tilt, ``rate = min(cap, exp(multiplier * size / mean size))``, with one
multiplier for each source: the convex dual.  Newton iterations find all multipliers at once; each iteration is one
aggregation.  Rates depend on a document only through source and size, so iterations run on the counts of
``(source, size)`` cells, which do not grow with the number of documents of a cell.

Rates become whole copies cell by cell, from large to small sizes, carrying the words still owed; so each source's total
is off by about half of one of its smallest documents.  Within a cell, a hash of the id says who gets the odd copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordinal import row_index
from ..runtime import materialise
from . import words
from .common import rank_in_groups

#: Newton iterations at most, and the relative error of a source's tokens that ends them.
ITERATIONS, TOLERANCE = 80, 1e-9


def _sizes(batches):
    for rows, raw, offsets in words.blocks(batches):
        counts = words.word_counts(raw, offsets)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "size"])


def _source_key(source: Column) -> Column:
    """Joins treat a null source as a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def water_level(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: ``share`` of all tokens split by ``weight``, none above ``cap`` times the source's size.

    What a source can't take is shared again by weight.  Each round is one aggregation of the table of sources.
    """
    totals = sources.agg(F.sum("source_size").alias("all")).first()
    everything = share * float(totals["all"] or 0)
    level, full = 0.0, 0
    limit = cap * F.col("source_size")
    while True:
        # a source that is full at a level stays so: levels only rise
        is_full = F.lit(level) * F.col("weight") > limit if level else F.lit(False)
        row = sources.agg(
            F.sum(F.when(is_full, limit).otherwise(0.0)).alias("held"), F.sum(F.when(~is_full, F.col("weight")).otherwise(0)).alias("open"),
            F.sum(is_full.cast("long")).alias("full"),
        ).first()
        if level and row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (everything - row["held"]) / row["open"]
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def tilt(cells: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """``(key, multiplier)`` that meets every source's target; a source that needs ``cap`` throughout has null."""
    mean = cells.filter("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = sources.filter((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))).join(mean, "key").select(
        "key", "target", "mean", F.lit(0.0).alias("multiplier"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"))
    state = materialise(state, "multipliers")
    for _ in range(ITERATIONS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("multiplier") * x, F.lit(50.0)))
        capped = rate >= cap
        tokens = F.col("n") * F.col("size")
        sums = cells.join(state.filter("not done"), "key").groupBy("key").agg(
            F.sum(tokens * F.least(rate, F.lit(cap))).alias("tokens"), F.sum(F.when(capped, 0.0).otherwise(tokens * rate * x)).alias("slope"))
        off = F.col("tokens") - F.col("target")
        m = F.col("multiplier")
        lo, hi = F.when(off < 0, m).otherwise(F.col("lo")), F.when(off > 0, m).otherwise(F.col("hi"))
        inf = F.lit(float("inf"))
        middle = F.when(lo == -inf, 2 * m - 1).when(hi == inf, 2 * m + 1).otherwise((lo + hi) / 2)
        newton = F.when(F.col("slope") > 0, m - off / F.col("slope"))
        step = F.when(newton.isNotNull() & (newton > lo) & (newton < hi), newton).otherwise(middle)
        met = F.coalesce(F.abs(off) <= TOLERANCE * F.col("target"), F.col("done"))
        state = materialise(state.join(sums, "key", "left").select(
            "key", "target", "mean", F.when(met, m).otherwise(step).alias("multiplier"), F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"), met.alias("done")), "multipliers")
        if state.filter("not done").limit(1).count() == 0:
            break
    return state.select("key", "mean", "multiplier")


def _round_cells(cap: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """One source: whole copies for each size, the words still owed carried on to smaller sizes."""
        cells = cells.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
            owed += size * n * rate
            m = round(min(cap * n, max(0, owed / size))) if size else n
            owed -= m * size
            copies.append(m)
        return cells.assign(copies=copies)[["key", "size", "n", "rate", "copies"]]

    return run


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, rate)`` of every row.

    Sizes are words between ASCII white space; sources are ordered by code point, null last, and weigh ``weights`` in
    turn.  A null or blank text has size 0 and keeps one copy, which takes no words.  Copies are 0 to ``cap``.  Repeated
    rows are documents of their own.  Rows without id take part like others.  The result is the same in every run.  An
    empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    sized = picked.mapInArrow(_sizes, f"doc_id {id_type}, source string, size long").withColumn("key", _source_key(F.col("source")))
    sized = materialise(sized, "sizes")
    cells = materialise(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "cells")

    sources = materialise(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    places = row_index(sources, [F.col("key") == "", "key"], key="key")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))
    sources = materialise(sources.join(places, "key").select("key", "source_size", turn.alias("weight")), "sources")
    sources = materialise(water_level(sources, share, cap), "sources")

    multipliers = tilt(cells, sources, float(cap))
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0))))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(tilted)
    rated = cells.join(sources, "key").join(multipliers, "key", "left").select("key", "size", "n", rate.alias("rate"))
    rounded = materialise(rated.groupBy("key").applyInPandas(_round_cells(float(cap)), "key string, size long, n long, rate double, copies long"), "copies")

    odd = rounded.filter("copies % n != 0").select("key", "size", F.col("n").alias("group_rows"))
    spread = F.xxhash64("doc_id", "key")
    ranked = rank_in_groups(sized.select("doc_id", "key", "size").join(odd.select("key", "size"), ["key", "size"], "left_semi"), ["key", "size"], [spread, "doc_id"], odd, spread)
    whole = rounded.filter("copies % n = 0").select("key", "size")
    plain = sized.select("doc_id", "key", "size").join(whole, ["key", "size"], "left_semi").withColumn("rank", F.lit(0).cast("long"))
    every = ranked.select("doc_id", "key", "size", "rank").union(plain.select("doc_id", "key", "size", "rank"))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("rank") < F.col("copies") % F.col("n")).cast("long")
    return every.join(rounded, ["key", "size"]).join(sources, "key").select(
        "doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"), own.cast("int").alias("copies"), "rate")


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, all columns unchanged.

    Rows that share an id take the rounded mean of their copies; rows without id, which can't be told apart, one.
    """
    decided = mix(docs, weights, share, cap).filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.round(F.avg("copies")).cast("int").alias("__copies"))
    joined = docs.join(decided, F.col("doc_id") == F.col("__id"), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1))).filter("__copies > 0")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")
