"""Interaction of document filters: what every order of the same filters removes, step by step.

A document's failure mask says which filters it fails.  Per part, the masks' counts become a decision diagram with one level
a filter: a node's branches are "passes" and "fails", its total counts the documents below it, equal nodes are shared.
Swapping two adjacent levels gives the diagram of a neighbouring order; all orders follow from one another by such swaps.
The path that passes everywhere holds the steps of an order: what fails on it is removed there, what passes is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from . import words

#: The row-local filters by letter; E, copies of a smaller id's text, needs the whole table.
LETTERS = "ABCDE"
_COPY = 1 << 4
_CAPITAL, _SIGN, _HEAD = (np.zeros(256, dtype=bool) for _ in range(3))
_CAPITAL[65:91] = True
_SIGN[list(b"#$%&*|")] = True
_HEAD[:] = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def local_masks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 0 to 3: A under 50 words, B under 65 % distinct words, C over 5 % capitals, D holds one of ``#$%&*|``."""
    n = len(offsets) - 1
    hashes, rows = words.word_hashes(raw, offsets, "exact")
    count = np.bincount(rows, minlength=n)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    distinct = np.bincount(rows[new], minlength=n)
    fails = [count < 50, 100 * distinct < 65 * count, 100 * _per_row(_CAPITAL[raw], offsets) > 5 * _per_row(_HEAD[raw], offsets), _per_row(_SIGN[raw], offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failure_masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, mask)``: the row-local bits of every row and a 128-bit digest of its text."""
    picked = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches):
        for rows, raw, offsets in words.blocks(batches):
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [rows.column("doc_id"), rows.column("part"), pa.array(digests, pa.binary()), pa.array(local_masks(raw, offsets), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents, good and toxic ones of each part fail just these filters.

    Equal rows are counted before anything is joined.  The smallest id of a text is a map-side combined minimum and meets
    its row again by text and id, so a text that a third of all rows share is dealt over all tasks.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    counted = failure_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    counted = materialise(counted, "failure-masks")
    first = counted.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, F.lit(_COPY)).otherwise(F.lit(0))
    part = counted.join(first, ["digest", "doc_id"], "left").select("part", mask.alias("mask"), "n", "good", "toxic")
    total = lambda flag: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0)))
    return part.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def adjacent_swaps(n: int) -> list[int]:
    """Levels to swap with the next one, so that the orders passed through are all ``n!``, each once."""
    if n < 2:
        return []
    out: list[int] = []
    inner = adjacent_swaps(n - 1)
    for i in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if i % 2 == 0 else range(n - 1)
        if i < len(inner):
            out.append(inner[i] + (i % 2 == 0))
    return out


class Diagram:
    """A decision diagram whose leaves are count vectors; every node knows the sum of the leaves below it.

    Nodes are numbers; equal nodes are one.  No level is skipped, so each order has the same five levels.
    """

    def __init__(self, variables: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(variables))
        self.nodes: list[tuple] = []
        self.known: dict[tuple, int] = {}
        none = (0,) * width

        def build(level: int, mask: int) -> int:
            if level == variables:
                return self._node(None, None, tuple(counts.get(mask, none)))
            return self._branch(build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _node(self, passes: int | None, fails: int | None, total: tuple[int, ...]) -> int:
        key = (passes, fails, total)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _branch(self, passes: int, fails: int) -> int:
        return self._node(passes, fails, tuple(a + b for a, b in zip(self.nodes[passes][2], self.nodes[fails][2], strict=True)))

    def swap(self, level: int) -> None:
        """Exchange this level and the next; the counts below the two stay where they are."""
        done: dict[int, int] = {}

        def again(node: int, depth: int) -> int:
            if node not in done:
                passes, fails, _ = self.nodes[node]
                if depth < level:
                    done[node] = self._branch(again(passes, depth + 1), again(fails, depth + 1))
                else:
                    (pp, pf, _), (fp, ff, _) = self.nodes[passes], self.nodes[fails]
                    done[node] = self._branch(self._branch(pp, fp), self._branch(pf, ff))
            return done[node]

        self.root = again(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, counts kept, counts removed) along the path that passes everywhere."""
        node = self.root
        for variable in self.order:
            passes, fails, _ = self.nodes[node]
            yield variable, self.nodes[passes][2], self.nodes[fails][2]
            node = passes


STEP_SCHEMA = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(part: str, counts: dict[int, tuple[int, ...]], letters: str) -> list[tuple]:
    """Rows of ``STEP_SCHEMA`` for all orders of one part's filters; ``counts`` are (documents, good, toxic) by mask."""
    diagram = Diagram(len(letters), counts, 3)
    failing = [sum(n[0] for m, n in counts.items() if m >> i & 1) for i in range(len(letters))]
    alone, shapley, rows = [0] * len(letters), [0] * len(letters), []
    for swap in [None, *adjacent_swaps(len(letters))]:
        if swap is not None:
            diagram.swap(swap)
        name = "".join(letters[i] for i in diagram.order)
        for step, (i, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[i] += removed[0]
            if step == len(letters):
                alone[i] = removed[0]
            rows.append((name, step, i, kept[0], *removed))
    return [(part, name, step, letters[i], kept, gone, failing[i] - gone, alone[i], good, toxic, shapley[i]) for name, step, i, kept, gone, good, toxic in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; columns as in ``STEP_SCHEMA``.

    ``docs(doc_id, text, source)``, ``labels(doc_id, quality, toxic)``.  A null text is empty, a null source the part ``''``.
    A row without id is nobody's copy and has no copies; rows that repeat an id are no copies of each other.  Of repeated
    labels one that says 1 is enough.  An empty table gives no rows; other columns are ignored.  A group of the last step
    is one part with at most 32 rows of counts.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(frame["mask"], frame["n"], frame["good"], frame["toxic"], strict=True)}
        return pd.DataFrame(orders_of(frame["part"].iloc[0], counts, LETTERS), columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(run, STEP_SCHEMA)
