"""Removal of long repeated substrings, exact to the byte, over all documents.

A window is ``length`` bytes of one document; it is repeated if an equal window starts anywhere else.  Every window has an
anchor: the ``ANCHOR`` bytes in it with the smallest hash, the leftmost of equal ones.  Equal windows have equal anchors at
equal offsets, so only windows with the same anchor bytes can be equal, and neighbouring windows that share an anchor
travel as one stretch.  Then:

1. Stretches whose anchor occurs once hold no repeated window.
2. A stretch of which all occurrences of the anchor are copies is repeated as a whole; so is any stretch with a copy.
3. What is left are anchors with different stretches, where copies begin or end or near copies differ.  One text of each
   different stretch is fetched.  Blocks of stretches are cut into 16-byte symbols aligned to their anchors, and the suffix
   array of the symbols (``suffixes``) names equal cores; a window is a core with the few bytes left on both sides.
4. An anchor with more than ``HOT`` different stretches would be too much for one block.  Its windows are digested, and
   fragments of the digests' range say which occur again: exact too, and spread over tasks whatever the anchor.

Rows are keyed by the hash of their text: copies of a document share their spans.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from . import words
from .common import partitions
from .suffixes import suffix_array

#: Bytes of an anchor, of a symbol, different stretches of one anchor in a block, and stretches of a block.
ANCHOR, SYMBOL, HOT, STRETCHES = 64, 16, 256, 1500
#: A key with more than one in so many of all stretches is heavy, so there are fewer heavy keys than this.
HEAVY = 1000
_SEGMENT = 1 << 20
_VALUES = np.random.default_rng(79).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverses = words._tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers[: len(raw)], out=sums[1:])
    return sums, inverses


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor place, anchor, content) of all stretches; places count from the row's start."""
    n, k = len(raw), ANCHOR
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    windows = n - length + 1
    if windows <= 0:
        return none
    sums, inverses = _prefix_sums(raw)
    hashed = words.mix((sums[k:] - sums[:-k]) * inverses[: n - k + 1])
    bits = np.uint64(max(20, n.bit_length()))
    low = (hashed >> bits << bits) | np.arange(n - k + 1, dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:windows], low[width - span : width - span + windows])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.ones(windows, dtype=bool)
    for edge in offsets[1:-1]:
        valid[max(0, edge - length + 1) : edge] = False
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [windows]]) - 1
    first, last = first[valid[first]], last[valid[first]]
    if not len(first):
        return none
    # windows of neighbouring rows never merge: those across an edge lie between them
    at = anchor[first]
    shape = (at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    content = words.mix(words.mix((sums[last + length] - sums[first]) * inverses[first]) + shape)
    row = words.rows_of(first, offsets)
    begin = offsets[row]
    return row, first - begin, last - begin, at - begin, hashed[at], content


def _stretch_rows(length: int):
    def run(batches):
        for rows, raw, offsets in words.blocks(batches, size=_SEGMENT):
            keys = rows.column("text_key").to_numpy()
            for begin in range(0, max(1, len(raw)), _SEGMENT if rows.num_rows == 1 else max(1, len(raw))):
                if rows.num_rows == 1:  # a long text in overlapping segments
                    part = raw[begin : begin + _SEGMENT + length - 1]
                    found = stretches(part, np.array([0, len(part)]), length)
                else:
                    found = stretches(raw, offsets, length)
                row, first, last, at, anchor, content = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row]), *(pa.array((x + begin).astype(np.int32)) for x in (first, last, at)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["text_key", "first", "last", "at", "anchor", "content"])

    return run


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


_STRETCH = pa.schema([("hot", pa.bool_()), ("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("offset", pa.int32()), ("data", pa.binary())])
_SPANS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])


def _fetch(length: int):
    """The texts of wanted stretches; rows come sorted by text, so a copy follows its like and is skipped."""

    def run(batches):
        before = None
        for batch in batches:
            out = []
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "wanted")), strict=True):
                if key == before:
                    continue
                before, data = key, text.encode()
                out += [(w["hot"], w["anchor"], w["content"], w["copies"], w["at"] - w["first"], data[w["first"] : w["last"] + length]) for w in wanted]
            columns = zip(*out, strict=True) if out else [[]] * len(_STRETCH)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _STRETCH, strict=True)], schema=_STRETCH)

    return run


def _distinct(table: pa.Table) -> list[tuple]:
    rows = zip(*(table.column(c).to_pylist() for c in ("anchor", "content", "copies", "offset", "data")), strict=True)
    return list({(r[0], r[1]): r for r in rows}.values())


def _as_spans(rows: list[tuple], owner: np.ndarray, start: np.ndarray, length: int) -> pa.Table:
    """Spans, counted from the anchor, that the repeated windows of each stretch cover."""
    cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
    out = []
    for i, (anchor, content, _, offset, _) in enumerate(rows):
        own = start[cuts[i] : cuts[i + 1]]
        if len(own):
            s, e = _merge(own, own + length)
            out.append((anchor, content, [{"s": int(a) - offset, "e": int(b) - offset} for a, b in zip(s, e, strict=True)]))
    columns = zip(*out, strict=True) if out else [[]] * len(_SPANS)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SPANS, strict=True)], schema=_SPANS)


def _by_suffix_array(length: int):
    core = (length - SYMBOL + 1) // SYMBOL  # symbols of a core
    rest = length - core * SYMBOL  # bytes of a window beside its core

    def run(table: pa.Table) -> pa.Table:
        rows = _distinct(table)
        pad = 2 * SYMBOL
        raw = np.frombuffer(b"".join(r[4] + bytes(pad) for r in rows), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r[4]) + pad for r in rows])])
        places, owners = [], []
        for i, (_, _, _, offset, data) in enumerate(rows):
            lead = offset % SYMBOL
            count = max(0, (len(data) - lead) // SYMBOL)
            places.append(begin[i] + lead + SYMBOL * np.arange(count))
            owners.append(np.full(count + 1, i))
        at = np.concatenate(places)
        blocks = np.ascontiguousarray(raw[at[:, None] + np.arange(SYMBOL)]).view(">u8").reshape(-1, 2) if len(at) else np.zeros((0, 2), ">u8")
        _, names = np.unique(blocks, axis=0, return_inverse=True)
        counts = [len(p) for p in places]
        ends = np.cumsum(np.array(counts) + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # 0 ends every stretch
        body = np.ones(len(text), dtype=bool)
        body[ends - 1] = False
        text[body] = names.ravel() + 1
        where = np.zeros(len(text), np.int64)
        where[body] = at
        owner = np.concatenate(owners)
        order = np.array(suffix_array(text.tolist()), np.int64)

        left = ends[owner] - 1 - np.arange(len(text))  # symbols up to the stretch's end
        order = order[left[order] >= core]
        if not len(order):
            return _SPANS.empty_table()
        seen = np.lib.stride_tricks.sliding_window_view(text, core)[order]
        name = np.concatenate([[0], np.cumsum((seen[1:] != seen[:-1]).any(axis=1))]).astype(np.uint64)
        weight = np.minimum(np.array([r[2] for r in rows]), 2)
        found_owner, found_start, key, heavy = [], [], [], []
        for o in range(SYMBOL):  # a window begins so many bytes before its core
            start = where[order] - o
            own = owner[order]
            fits = (start >= begin[own]) & (start + length <= begin[own + 1] - pad)
            start, own = start[fits], own[fits]
            beside = np.zeros((len(start), 32), np.uint8)
            beside[:, :o] = raw[start[:, None] + np.arange(o)]
            beside[:, o:rest] = raw[start[:, None] + np.arange(o + core * SYMBOL, length)]
            mixed = words.mix(name[fits] * np.uint64(SYMBOL) + np.uint64(o))
            for column in beside.view(np.uint64).T:
                mixed = words.mix(mixed ^ column)
            found_owner.append(own)
            found_start.append(start - begin[own])
            key.append(mixed)
            heavy.append(weight[own])
        own, start, key, heavy = (np.concatenate(x) for x in (found_owner, found_start, key, heavy))
        _, inverse = np.unique(key, return_inverse=True)
        again = np.bincount(inverse, weights=heavy)[inverse] >= 2
        own, start = own[again], start[again]
        by = np.lexsort((start, own))
        return _as_spans(rows, own[by], start[by], length)

    return run


# -- anchors with very many different stretches ----------------------------------------------------------


def _digests(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, digest) of every window."""
    owner, start, out = [], [], []
    for i, r in enumerate(rows):
        raw = np.frombuffer(r[4], np.uint8)
        sums, inverses = _prefix_sums(raw)
        n = len(raw) - length + 1
        out.append(words.mix((sums[length:] - sums[:-length]) * inverses[:n]))
        owner.append(np.full(n, i))
        start.append(np.arange(n))
    return tuple(np.concatenate(x) for x in (owner, start, out))


def _send_digests(length: int, fragments: int):
    def run(batches):
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            rows = _distinct(pa.Table.from_batches([batch]))
            for first in range(0, len(rows), 1024):
                part = rows[first : first + 1024]
                owner, _, key = _digests(part, length)
                copies = np.minimum(np.array([r[2] for r in part]), 2)[owner]
                distinct, inverse = np.unique(key, return_inverse=True)
                twice = np.bincount(inverse, weights=copies) >= 2
                frag = ((distinct >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                cuts = np.searchsorted(frag, np.arange(fragments + 1))
                out = [(-1 - block % fragments, block, None, None, pickle.dumps(part))]
                out += [(f, block, distinct[a:b].tobytes(), twice[a:b].tobytes(), None) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["frag", "block", "keys", "twice", "info"])
                block += 1

    return run


def _find_again(table: pa.Table) -> pa.Table:
    """A fragment: back to each block those of its digests that occur again."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "keys", "twice", "info")), strict=True))
    out = [(b, None, i) for b, _, _, i in rows if i is not None]
    held = [(b, np.frombuffer(k, np.uint64), np.frombuffer(t, bool)) for b, k, t, i in rows if i is None]
    if held:
        _, inverse = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
        again = np.bincount(inverse, weights=1 + np.concatenate([t for *_, t in held]))[inverse] >= 2
        at = 0
        for b, k, _ in held:
            own = k[again[at : at + len(k)]]
            at += len(k)
            if len(own):
                out.append((b, own.tobytes(), None))
    columns = zip(*out, strict=True) if out else [[]] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "info"])


def _mark(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = pickle.loads(next(i for i in table.column("info").to_pylist() if i is not None))
        known = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist() if k is not None]
        owner, start, key = _digests(rows, length)
        again = np.isin(key, np.concatenate(known)) if known else np.zeros(len(key), dtype=bool)
        return _as_spans(rows, owner[again], start[again], length)

    return run


# -- the whole ---------------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has each key once with its ``count``.

    Rows of heavy keys stay where they are and meet a broadcast of fewer than ``HEAVY`` keys; all others are shuffled.
    """
    heavy = F.col(count) * HEAVY > F.lit(total)
    few = facts.filter(heavy)
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.filter(~heavy), keys)
    return rows.join(F.broadcast(few), keys).unionByName(others)


def repeated_spans(docs: DataFrame, length: int = 400, text_column: str = "text") -> DataFrame:
    """``(text_key, spans)``: byte spans that repeated windows cover, for every text that has some."""
    spark = docs.sparkSession
    texts = docs.select(text_key(F.col(text_column)).alias("text_key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") >= length)
    every = materialise(texts.mapInArrow(_stretch_rows(length), "text_key long, first int, last int, at int, anchor long, content long"), "stretches")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("n > 1")
    anchors = materialise(anchors.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("differ")), "anchors")
    total = every.count()
    again = materialise(_with_facts(every, anchors, ["anchor"], "n", total).drop("n"), "repeated")

    kinds = again.filter("differ").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_key", "first", "last", "at")).alias("one"))
    kinds = materialise(kinds, "kinds")
    hot = kinds.groupBy("anchor").agg((F.count(F.lit(1)) > HOT).alias("hot"))
    wanted = kinds.join(hot, "anchor").groupBy(F.col("one.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("hot", "anchor", "content", "copies", "one.first", "one.last", "one.at")).alias("wanted"))
    fetched = materialise(texts.join(wanted, "text_key").sortWithinPartitions("text_key").mapInArrow(_fetch(length), "hot boolean, anchor long, content long, copies long, offset int, data binary"), "texts")

    spans = "anchor long, content long, spans array<struct<s:int,e:int>>"
    blocks = max(partitions(spark), -(-kinds.count() // STRETCHES))
    sorted_ = fetched.filter("not hot").groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("frag")).applyInArrow(_by_suffix_array(length), spans)
    fragments = partitions(spark)
    sent = fetched.filter("hot").mapInArrow(_send_digests(length, fragments), "frag int, block long, keys binary, twice binary, info binary")
    digested = sent.groupBy("frag").applyInArrow(_find_again, "block long, keys binary, info binary").groupBy("block").applyInArrow(_mark(length), spans)

    whole = F.array(F.struct(F.col("first").alias("s"), (F.col("last") + length).alias("e")))
    copied = again.filter("not differ").select("text_key", whole.alias("spans"))
    known = _with_facts(again.filter("differ"), kinds.select("anchor", "content", "copies"), ["anchor", "content"], "copies", total)
    partly = known.filter("copies = 1").join(sorted_.union(digested), ["anchor", "content"])
    moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e")))
    same = known.filter("copies > 1").select("text_key", whole.alias("spans"))
    found = copied.union(partly.select("text_key", moved.alias("spans"))).union(same)
    return found.groupBy("text_key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))


def _removed(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    s, e = _merge(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans]))
    return list(zip(s.tolist(), np.minimum(e, n).tolist(), strict=True))


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _summary(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode()
            runs = _removed(spans, len(data))
            out.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_cut(data, runs)).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_summary(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row: what removal does to it.

    Null texts are empty; texts shorter than ``length`` lose nothing.  Copies of a long enough text lose all.  Repeated
    rows are copies; rows without id take part.  An empty table gives no rows.  Other columns are ignored.
    """
    spans = repeated_spans(docs, length, text_column)
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    joined = picked.withColumn("text_key", text_key(F.col("text"))).join(spans, "text_key", "left").select("doc_id", "text", "spans")
    id_type = picked.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_summary, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(batches):
    for batch in batches:
        texts = [
            text if text is None or not spans else _cut(data := text.encode(), _removed(spans, len(data))).decode(errors="ignore")
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)
        ]
        names = [n for n in batch.schema.names if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "__kept"])


def without_repeats(docs: DataFrame, length: int = 400, text_column: str = "text") -> DataFrame:
    """``docs`` with repeated spans cut out of the text; half characters at the cuts go as well."""
    spans = repeated_spans(docs, length, text_column).withColumnsRenamed({"text_key": "__key", "spans": "__spans"})
    others = [c for c in docs.columns if c != text_column]
    joined = docs.select(*others, F.col(text_column).alias("__text"), text_key(F.col(text_column)).alias("__key")).join(spans, "__key", "left").select(*others, "__text", "__spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*others).schema) + ", __kept string"
    kept = joined.mapInArrow(_kept_text, schema if others else "__kept string")
    return kept.select(*[F.col("__kept").alias(text_column) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
