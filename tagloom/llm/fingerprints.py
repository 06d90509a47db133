"""Document fingerprints by consistent weighted sampling.

Terms are pairs of consecutive lower-cased words, weighted by their number.  For each of ``SAMPLES`` samples a term has
three fixed random numbers, two gamma distributed and one uniform; with its weight they give a value, and the term of
the smallest value (with the step its weight falls on) is the sample.  Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity.  The random numbers are a mix of the sample and the term's 64-bit hash
and depend on nothing else, so texts of any length can be fingerprinted anywhere, in any order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import partitions

#: Samples of a fingerprint, each 16 bits.
SAMPLES = 64
#: Terms whose random numbers are drawn at a time.
BLOCK = 512
#: Weighted terms whose numbers are held at a time.
RUN = 1 << 16
_seeds = words.mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, SAMPLES)


def _uniform(terms: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """By term and sample two numbers above 0 and at most 1: the halves of a mix of both."""
    halves = words.mix(terms[:, None] ^ _seeds[which]).view(np.uint32).reshape(len(terms), SAMPLES, 2) >> np.uint32(8)
    return tuple((halves[:, :, i].astype(np.float32) + np.float32(1)) * np.float32(2.0**-24) for i in (0, 1))


def _random_numbers(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By term and sample: log c, r and beta."""
    a, b = _uniform(terms, 0)
    c, d = _uniform(terms, 1)
    r, log_c = np.maximum(-np.log(a * b), np.float32(1e-6)), np.log(np.maximum(-np.log(c * d), np.float32(1e-12)))
    return log_c, r, _uniform(terms, 2)[0]


def _values(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, step) by weighted term and sample."""
    value, step = np.empty((len(terms), SAMPLES), np.float32), np.zeros((len(terms), SAMPLES), np.float32)
    for first in range(0, len(terms), BLOCK):
        part = slice(first, first + BLOCK)
        log_c, r, beta = _random_numbers(terms[part])
        more = np.flatnonzero(counts[part] > 1)
        if len(more):
            step[first + more] = np.floor(np.log(counts[part][more]).astype(np.float32)[:, None] / r[more] + beta[more])
        value[part] = log_c - r * (step[part] - beta + 1)
    return value, step


def _least(terms: np.ndarray, counts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The samples of ``n`` texts whose terms follow each other; ``of`` is the text of each term.

    Terms are taken in runs; what several texts of a run hold with the same weight is drawn once.
    """
    best, code = np.full((n, SAMPLES), np.inf, np.float32), np.zeros((n, SAMPLES), np.uint64)
    for first in range(0, len(terms), RUN):
        t, c, text = (x[first : first + RUN] for x in (terms, counts, of))
        order = np.lexsort((c, t))
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[order][1:] != t[order][:-1]) | (c[order][1:] != c[order][:-1])
        place = np.empty(len(t), np.int64)
        place[order] = np.cumsum(new) - 1
        value, step = _values(t[order][new], c[order][new])
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for a, b in zip(heads, [*heads[1:], len(t)], strict=True):
            at = a + value[place[a:b]].argmin(axis=0)
            low, steps = value[place[at], np.arange(SAMPLES)], step[place[at], np.arange(SAMPLES)].astype(np.int64)
            better = low < best[text[a]]
            found = words.mix(t[at] ^ words.mix(steps.astype(np.uint64)))
            best[text[a], better], code[text[a], better] = low[better], found[better]
    return code


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of ``SAMPLES`` 16-bit numbers for each text; all zero for a text without words."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, rows = words.word_hashes(raw, offsets)
    keys, of = words.shingles(hashes, rows, len(texts), 2)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])[: len(keys)])
    counts = np.diff(np.append(first, len(keys)))
    code = _least(keys[first], counts, of[first], len(texts))
    out = (code & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    out[np.bincount(of, minlength=len(texts)) == 0] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (a == b).mean(axis=1)


def _fingerprint_rows(batches):
    """Rows sorted by bucket; each document is followed by the next one, the last of a bucket by the next bucket's first."""

    def finish(group: list[tuple]):
        shown = [i for i, row in enumerate(group[:-1]) if not row[2]]
        if not shown:
            return None
        texts = [row[3] or "" for row in group]
        edited = []
        for i in shown:
            own = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - own] + texts[i + 1][:own])
        plain, changed = [t.encode() for t in texts], [t.encode() for t in edited]
        # An edited text follows its own, of which it has most terms.
        at = sorted([(i, 0, t) for i, t in enumerate(plain)] + [(i, 1, t) for i, t in zip(shown, changed, strict=True)], key=lambda x: x[:2])
        prints = fingerprints([t for *_, t in at])
        place = {x[:2]: i for i, x in enumerate(at)}
        own, after, other = (prints[[place[x] for x in xs]] for xs in ([(i, 0) for i in shown], [(i + 1, 0) for i in shown], [(i, 1) for i in shown]))
        return pa.RecordBatch.from_arrays([
            pa.array([group[i][1] for i in shown], pa.int64()), pa.array([len(texts[i]) for i in shown], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array([x.astype(">u2").tobytes().hex() for x in own]),
            pa.array([x.astype(">u2").tobytes().hex() for x in other]), pa.array(likeness(own, other)), pa.array(likeness(own, after)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    group, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "extra", "text")), strict=True):
            if group and group[-1][2] and row[2] and group[-1][0] == row[0]:
                continue  # several rows of the next bucket's first id: the first will do
            group.append(row)
            size += len(row[3] or "")
            if size > 1 << 20 and not row[2]:
                if (out := finish(group)) is not None:
                    yield out
                group, size = [row], len(row[3] or "")
    if group and (out := finish([*group, (None, None, 1, "")])) is not None:
        yield out


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The edited text has its last third replaced by the beginning of the next document by descending id, the first
    following the last.  Rows with the same id follow each other by text; rows without id come last.  A null text is
    empty; texts without words have a fingerprint of zeros and are like each other.  An empty table gives no rows.
    Other columns are ignored.

    Ids are cut into ranges at quantiles; each range is sorted by itself and gets the first document of the next one.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    buckets = 2 * partitions(spark)
    cuts = picked.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    limits = np.unique(np.array(sorted(cuts, reverse=True)) * -1)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), len(limits) + 1, np.searchsorted(limits, -ids.fillna(0).astype(float), side="right"))).astype("int32")

    placed = picked.withColumn("bucket", bucket_of("doc_id"))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # one row a bucket
    after = [(heads[(i + 1) % len(heads)]["head"], h["bucket"]) for i, h in enumerate(heads)]
    bounded = spark.createDataFrame(after, "head long, before int").groupBy("head").agg(F.collect_list("before").alias("before"))
    rows = placed.join(F.broadcast(bounded), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    rows = rows.select(F.posexplode(F.concat(F.array("bucket"), F.coalesce("before", F.array().cast("array<int>")))).alias("extra", "bucket"), "doc_id", "text")
    rows = rows.withColumn("extra", F.least("extra", F.lit(1))).repartition(partitions(spark), "bucket")
    rows = rows.sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(_fingerprint_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
