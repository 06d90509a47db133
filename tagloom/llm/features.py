"""Sparse text features for linear models, and the bounded labelled sample such models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from . import words

#: Features are hashed to 18 bits; with at most 2**14 rows in a block, row and feature fit 32 bits.
BITS = 18
DIM = 1 << BITS
_ROWS = 1 << 14
_MASK = np.uint64(DIM - 1)

#: Tasks that a pass over the bounded sample has at most: each sends one row of fixed size to the driver.
TASKS = 16
#: Tasks that add up what the others have found for every feature, and numbers in a row that the driver gets of them.
SUMS, SLICE = 4, 1 << 14

Extractor = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def words_and_stems(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lower-cased words without marks, and their first 4, 5 and 6 bytes: inflected forms share a stem."""
    return [words.word_hashes(raw, offsets, "plain"), *words.stems(raw, offsets, (4, 5, 6))]


def styled_ngrams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words as written, pairs of them, byte trigrams, and how much of a text repeats the word before."""
    n = len(offsets) - 1
    hashes, rows = words.word_hashes(raw, offsets, "exact")
    pair = rows[1:] == rows[:-1]
    pairs = words.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[pair]
    wide = raw.astype(np.uint64)
    trigrams = words.mix((wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) + np.uint64(1 << 40)) if len(raw) > 2 else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    inside = of[2:] == of[:-2]
    count = np.bincount(rows, minlength=n)
    repeats = np.bincount(rows[1:][pair & (hashes[1:] == hashes[:-1])], minlength=n) / np.maximum(count, 1)
    level = np.searchsorted(np.array([0.02, 0.1, 0.25, 0.5]), repeats, side="right")
    same = words.mix(np.uint64(7) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [(hashes, rows), (pairs, rows[1:][pair]), (trigrams[inside], of[2:][inside]), (same, np.arange(n))]


def indicators(batches, extract: Extractor) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, row, feature): the distinct features of each row, sorted."""
    for rows, raw, offsets in words.blocks(batches, most=_ROWS):
        found = extract(raw, offsets)
        keys = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS) | h & _MASK).astype(np.uint32) for h, r in found])
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        yield rows, (keys >> np.uint32(BITS)).astype(np.int64), (keys & np.uint32(DIM - 1)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, extract: Extractor) -> DataFrame:
    """``(doc_id, label, features)`` of at most ``most`` labelled documents, chosen by a hash of the id.

    ``most`` bounds what is broadcast and what the fit reads; rows without id or label are no examples.  Contradicting
    labels of one document count as their maximum.  Features are little-endian 32-bit numbers.  The examples lie in
    ``TASKS`` parts, however many the documents have, so a pass sends as much to the driver at any size.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for rows, row, feature in indicators(batches, extract):
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
            own = feature.astype("<u4")
            data = [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(data, pa.binary())], names=["doc_id", "label", "features"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {id_type}, label int, features binary")
    return materialise(found.repartition(TASKS), "examples").coalesce(TASKS)


@contextmanager
def shared(sample: DataFrame, value) -> Iterator:
    """A broadcast of bounded size (weights, dual variables of the sample) that is gone, also from disk, afterwards."""
    sent = sample.sparkSession.sparkContext.broadcast(value)
    try:
        yield sent
    finally:
        sent.destroy()


def examples(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("features").to_pylist()]


def packed(numbers: np.ndarray) -> bytes:
    """64-bit floats compressed without loss, first bytes before second ones: sums of 32-bit floats end in zeros."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``packed`` got."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.float64)[:, 0]


def feature_sums(sample: DataFrame, add: Callable[[np.ndarray, Iterator[pa.RecordBatch]], None], n: int, more: int) -> np.ndarray:
    """The sums over the sample's parts of ``n + more`` numbers that ``add`` changes from 0; the first ``n`` are 32-bit floats of a part.

    ``SUMS`` tasks add the parts up, so the driver gets a few MB a pass at most, in rows of ``SLICE`` numbers: a row of a megabyte
    from every part would fill its heap pass by pass.  The rows are compressed without loss, since the driver's JVM copies each
    about ten times on its way to Python: features that no example holds take no room.
    """
    schema = "at int, part binary"

    def sliced(total: np.ndarray) -> pa.RecordBatch:
        parts = [(at, packed(total[at : at + SLICE])) for at in range(0, len(total), SLICE)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["at", "part"])

    def merge(total: np.ndarray, rows) -> None:
        for at, data in rows:
            total[at : at + SLICE] += unpacked(data, len(total[at : at + SLICE]))

    def one(batches):
        total = np.zeros(n + more)
        add(total, batches)
        total[:n] = total[:n].astype(np.float32)
        yield sliced(total)

    def some(batches):
        total = np.zeros(n + more)
        for batch in batches:
            merge(total, zip(batch.column("at").to_pylist(), batch.column("part").to_pylist(), strict=True))
        yield sliced(total)

    total = np.zeros(n + more)
    merge(total, sample.mapInArrow(one, schema).coalesce(SUMS).mapInArrow(some, schema).collect())
    return total


def class_counts(sample: DataFrame) -> tuple[np.ndarray, list[int]]:
    """How many examples of label 0 and of higher ones hold each feature, and how many there are of each."""

    def add(total, batches):
        held, kinds = total[: 2 * DIM].reshape(2, DIM), total[2 * DIM :]
        for batch in batches:
            for x, y in zip(examples(batch), batch.column("label").to_pylist(), strict=True):
                held[int(y > 0), x] += 1
                kinds[int(y > 0)] += 1

    total = feature_sums(sample, add, 2 * DIM, 2)
    return total[: 2 * DIM].reshape(2, DIM), total[2 * DIM :].astype(int).tolist()


def scored(docs: DataFrame, extract: Extractor, score: Callable[[np.ndarray], dict[str, np.ndarray]], weights: np.ndarray, schema: str) -> DataFrame:
    """Every row's id with what ``score`` makes of its sum of weights; a text without features sums to 0."""
    picked = docs.select("doc_id", "text")

    def run(batches):
        for rows, row, feature in indicators(batches, extract):
            sums = np.bincount(row, weights=weights[feature], minlength=rows.num_rows)
            found = score(sums)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x) for x in found.values())], names=["doc_id", *found])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {schema}")


def kept(docs: DataFrame, extract: Extractor, keep: Callable[[np.ndarray], np.ndarray], weights: np.ndarray) -> DataFrame:
    """The rows, with all their columns, whose sum of weights ``keep`` approves; nothing is shuffled."""

    def run(batches):
        for rows, row, feature in indicators(batches, extract):
            yield rows.filter(pa.array(keep(np.bincount(row, weights=weights[feature], minlength=rows.num_rows))))

    return docs.mapInArrow(run, docs.schema)
