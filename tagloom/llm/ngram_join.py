"""N-gram Jaccard join by vertical partitioning of the n-gram order.

All n-grams have a place in one global order, that of their 64-bit hash.  The order is cut into fragments of equal
width; every document falls into segments, one for each fragment its n-grams lie in.  A fragment is worked on alone: it
counts what it can see of a document or of a pair, and the partial counts are summed per document or per pair.

Documents with the same set are one class; one of them stands for it.  Three passes over fragments:

1. How many n-grams of each document occur nowhere else.  If these are more than ``(1 - threshold)`` of its set, nothing
   can be similar enough: an exact length filter that leaves copies and near copies.
2. The same among the classes left, with the number of classes that hold each n-gram: gives the prefix filter.
3. Partial overlaps of candidate pairs.  First each class against a few others that share a minimum hash; linked ones
   become one component.  Then some rounds in which a class meets a few leaders, of other components, of the n-grams of its
   prefix (rarest first), with components found anew in between.  At last all pairs from components that are still
   different and share an n-gram of both prefixes at places that leave room for the overlap they need, which completes
   the join as far as components go.  Pairs within one component need no further count, so a group of near copies costs
   its size and not its square.

Segments travel packed: a row holds what one block of documents has in one fragment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialise
from . import words
from .common import components, partitions

#: Entries of one packed block of documents.
BLOCK_ENTRIES = 600_000
#: Fragments in which pairs are counted: so many entries in each, but not fewer fragments than this.
FRAGMENT_ENTRIES, MIN_FRAGMENTS = 2_000_000, 24
#: Minimum hashes by which classes find their first partners.
LEADERS = 4
#: Rounds, at most, in which classes meet leaders of their prefix n-grams; how many of these in each; rounds end when a link
#: is found for fewer than one class in so many, and the last pass does the rest.
ROUNDS, PARTNERS, ENOUGH = 6, 6, 100
#: Classes that hold one prefix n-gram and are paired in one go; more are dealt to pairs of blocks of this size.
POSTING = 4000
_SHARED = np.uint16(65535)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _pack(keys: np.ndarray) -> bytes:
    """48 bits of each key; the fragment number stands for the highest ones."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _fragment(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _slices(fragments: np.ndarray):
    """(fragment, from, to) of sorted fragment numbers."""
    cuts = np.flatnonzero(np.diff(fragments)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(fragments)], strict=True):
        if hi > lo:
            yield int(fragments[lo]), int(lo), int(hi)


def _block_ids():
    """Numbers for the blocks of this task, the same if the task runs again."""
    context = TaskContext.get()
    n = (context.partitionId() if context else 0) << 32
    while True:
        yield n
        n += 1


SEGMENT = "frag int, block long, docs binary, keys binary, info binary"
_SEGMENT = pa.schema([("frag", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("info", pa.binary())])
_INFO = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8"), ("sig", "<u8"), ("sig2", "<u8")])


def signature(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(keys.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(words.mix(keys ^ np.uint64(0x5851F42D4C957F2D)))) if len(keys) else 0


def _emit(block: int, info: np.ndarray, docs: np.ndarray, keys: np.ndarray, fragments: int) -> pa.RecordBatch:
    """The segments of one block; an n-gram that several documents of it hold is sent once, marked as shared."""
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order].astype(np.uint16)
    if len(keys):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        again = np.zeros(len(keys), dtype=bool)
        again[:-1] |= ~new[1:]
        keys, docs = keys[new], np.where(again, _SHARED, docs)[new]
    frags = _fragment(keys, fragments)
    rows = [(-1 - block % fragments, block, None, None, info.tobytes())]
    for f, lo, hi in _slices(frags):
        o = np.argsort(docs[lo:hi], kind="stable")
        rows.append((f, block, docs[lo:hi][o].tobytes(), _pack(keys[lo:hi][o]), None))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)


def _from_texts(fragments: int, k: int, id_column: str):
    def run(batches):
        numbers = _block_ids()
        for rows, raw, offsets in words.blocks(batches):
            hashes, of = words.word_hashes(raw, offsets)
            keys, of = words.shingles(hashes, of, rows.num_rows, k)
            sets = words.distinct_by_row(keys, of, rows.num_rows)
            ids = rows.column(id_column).cast(pa.int64())
            info = np.zeros(rows.num_rows, dtype=_INFO)
            info["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            info["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            info["n"] = [len(s) for s in sets]
            signed = [signature(s) for s in sets]
            info["sig"], info["sig2"] = [x[0] for x in signed], [x[1] for x in signed]
            yield _emit(next(numbers), info, np.repeat(np.arange(len(sets)), info["n"]), np.concatenate(sets) if sets else np.zeros(0, np.uint64), fragments)

    return run


def _count_unshared(table: pa.Table) -> pa.Table:
    """A fragment: for each block, how many entries of each document no other document holds."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("info", pa.binary())])
    block, info = table.column("block").to_pylist(), table.column("info").to_pylist()
    out = [(b, None, None, i) for b, i in zip(block, info, strict=True) if i is not None]
    held = [(b, np.frombuffer(d, np.uint16), _unpack(k)) for b, d, k in zip(block, table.column("docs").to_pylist(), table.column("keys").to_pylist(), strict=True) if d is not None]
    if held:
        docs, keys = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        shared = docs == _SHARED
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        at = 0
        for b, d, _ in held:
            which, n = np.unique(d[~shared[at : at + len(d)]], return_counts=True)
            at += len(d)
            if len(which):
                out.append((b, which.tobytes(), n.astype("<u4").tobytes(), None))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)


def _sum_unshared(table: pa.Table) -> pa.Table:
    """A block: the fragments' counts summed per document."""
    info = np.frombuffer(next(i for i in table.column("info").to_pylist() if i is not None), dtype=_INFO)
    total = np.zeros(len(info), dtype=np.int64)
    for d, c in zip(table.column("docs").to_pylist(), table.column("counts").to_pylist(), strict=True):
        if d is not None:
            total[np.frombuffer(d, np.uint16)] += np.frombuffer(c, "<u4")
    return pa.table({
        "doc_id": pa.array(info["id"], mask=info["null"].astype(bool)), "n": pa.array(info["n"]), "sig": pa.array(info["sig"].view(np.int64)),
        "sig2": pa.array(info["sig2"].view(np.int64)), "unshared": pa.array(total),
    })


def document_sets(docs: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, n, sig, sig2, unshared)`` of every row: set size, signature, n-grams that no other row holds."""
    fragments = 4 * partitions(docs.sparkSession)
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    segments = picked.mapInArrow(_from_texts(fragments, k, "doc_id"), SEGMENT)
    counted = segments.groupBy("frag").applyInArrow(_count_unshared, "block long, docs binary, counts binary, info binary")
    return counted.groupBy("block").applyInArrow(_sum_unshared, "doc_id long, n long, sig long, sig2 long, unshared long")


# -- classes left after the first filter ------------------------------------------------------------


def _sets_of(k: int):
    def run(batches):
        for rows, raw, offsets in words.blocks(batches):
            hashes, of = words.word_hashes(raw, offsets)
            keys, of = words.shingles(hashes, of, rows.num_rows, k)
            sets = words.distinct_by_row(keys, of, rows.num_rows)
            wanted = zip(rows.column("n").to_pylist(), rows.column("sig").to_pylist(), rows.column("sig2").to_pylist(), strict=True)
            out = []
            for own, (n, sig, sig2) in zip(sets, wanted, strict=True):
                a, b = signature(own)
                if len(own) == n and np.array([a, b], np.uint64).view(np.int64).tolist() == [sig, sig2]:
                    out.append((sig, n, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", "keys"])

    return run


def _from_sets(fragments: int):
    """Segments of stored sets; the block's description carries node and size."""

    def run(batches):
        numbers = _block_ids()
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            nodes, sizes = batch.column("node").to_pylist(), batch.column("n").to_pylist()
            first = 0
            while first < len(sets):
                last, entries = first, 0
                while last < len(sets) and last - first < 60_000 and (last == first or entries + len(sets[last]) <= BLOCK_ENTRIES):
                    entries += len(sets[last])
                    last += 1
                info = np.zeros(last - first, dtype=_INFO)
                info["id"], info["n"] = nodes[first:last], sizes[first:last]
                part = sets[first:last]
                keys = np.concatenate(part)
                docs = np.repeat(np.arange(len(part)), [len(x) for x in part]).astype(np.uint16)
                block, frags = next(numbers), _fragment(keys, fragments)
                order = np.argsort(frags, kind="stable")
                rows = [(-1 - block % fragments, block, None, None, info.tobytes())]
                for f, lo, hi in _slices(frags[order]):
                    rows.append((f, block, docs[order][lo:hi].tobytes(), keys[order][lo:hi].tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)
                first = last

    return run


def _count_holders(table: pa.Table) -> pa.Table:
    """A fragment: back to each block the entries that several classes hold, with the number of holders."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("info", pa.binary())])
    block, info = table.column("block").to_pylist(), table.column("info").to_pylist()
    out = [(b, None, None, None, i) for b, i in zip(block, info, strict=True) if i is not None]
    held = [(b, np.frombuffer(d, np.uint16), np.frombuffer(k, np.uint64)) for b, d, k in zip(block, table.column("docs").to_pylist(), table.column("keys").to_pylist(), strict=True) if d is not None]
    if held:
        _, inverse, counts = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True, return_counts=True)
        holders, at = counts[inverse].astype("<u4"), 0
        for b, d, k in held:
            c = holders[at : at + len(d)]
            at += len(d)
            if (c > 1).any():
                out.append((b, d[c > 1].tobytes(), k[c > 1].tobytes(), c[c > 1].tobytes(), None))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def _prefixes(percent: int):
    """A block: shared n-grams, prefix (rarest first) and minimum hashes of the classes that can still have a partner."""

    def run(table: pa.Table) -> pa.Table:
        info = np.frombuffer(next(i for i in table.column("info").to_pylist() if i is not None), dtype=_INFO)
        parts = [(np.frombuffer(d, np.uint16), np.frombuffer(k, np.uint64), np.frombuffer(c, "<u4")) for d, k, c in zip(*(table.column(x).to_pylist() for x in ("docs", "keys", "counts")), strict=True) if d is not None]
        out = []
        if parts:
            docs, keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((keys, counts, docs))
            docs, keys = docs[order], keys[order]
            begin = np.searchsorted(docs, np.arange(len(info) + 1))
            for i, row in enumerate(info):
                own, n = keys[begin[i] : begin[i + 1]], int(row["n"])
                if 100 * len(own) < percent * n:
                    continue
                least = -(-percent * n // 100)  # entries that a partner must hold
                prefix = own[: max(0, n - least + 1 - (n - len(own)))]
                leaders = [int(words.mix(own ^ np.uint64(s)).min()) for s in range(1, LEADERS + 1)]
                out.append((int(row["id"]), n, own.tobytes(), prefix.view(np.int64), np.array(leaders, np.uint64).view(np.int64)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["node", "n", "keys", "prefix", "leaders"])

    return run


# -- partial overlaps of candidate pairs -------------------------------------------------------------


def _arrays(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)]


_PAIR_SEGMENT = pa.schema([("frag", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("partners", pa.binary())])
_PARTIAL = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("partners", pa.binary()), ("counts", pa.binary())])


def _segments_of_pairs(fragments: int):
    """A class's segments, each with the classes it is to be counted against; the first row has these and their sizes."""

    def run(batches):
        for batch in batches:
            out = []
            for node, n, keys, partners in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys", "partners")), strict=True):
                keys = np.sort(np.frombuffer(keys, np.uint64))
                known = {p["node"]: p["n"] for p in partners or []}
                partners = np.array(sorted(known), np.int64)
                sizes = np.array([known[p] for p in partners.tolist()], np.int64).tobytes()
                partners = partners.tobytes()
                if partners:
                    out.append((-1 - node % fragments, node, n, sizes, partners))
                for f, lo, hi in _slices(_fragment(keys, fragments)):
                    out.append((f, node, n, keys[lo:hi].tobytes(), partners))
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays(_arrays(out[at : at + 4096], _PAIR_SEGMENT), schema=_PAIR_SEGMENT)

    return run


def _partial_overlaps(table: pa.Table) -> pa.Table:
    """A fragment: for each class, how many n-grams of this fragment it has in common with each of its partners."""
    frag, nodes, n = table.column("frag").to_pylist(), table.column("node").to_numpy(), table.column("n").to_pylist()
    partners = table.column("partners").to_pylist()
    if frag[0] < 0:
        known = zip(nodes.tolist(), n, partners, table.column("keys").to_pylist(), strict=True)
        return pa.Table.from_arrays(_arrays(list(known), _PARTIAL), schema=_PARTIAL)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    ids, index = np.unique(nodes, return_inverse=True)
    places = index.astype(np.uint64) * _PLACE
    held = words.mix(np.concatenate([s + i for s, i in zip(sets, places, strict=True)]))
    held.sort()
    out = []
    for s, node, p in zip(sets, nodes.tolist(), partners, strict=True):
        p = np.frombuffer(p, np.int64)
        if not len(p):
            continue
        counts = np.zeros(len(p), "<u4")
        at = np.searchsorted(ids, p).clip(max=len(ids) - 1)
        there = np.flatnonzero(ids[at] == p)
        for first in range(0, len(there), 4096):  # a class with many partners is compared in blocks
            some = there[first : first + 4096]
            wanted = words.mix(s[None, :] + at[some].astype(np.uint64)[:, None] * _PLACE)
            found = np.searchsorted(held, wanted.ravel()).clip(max=len(held) - 1).reshape(wanted.shape)
            counts[some] = (held[found] == wanted).sum(axis=1)
        if counts.any():
            out.append((node, 0, None, counts.tobytes()))
    return pa.Table.from_arrays(_arrays(out, _PARTIAL), schema=_PARTIAL)


def _sum_overlaps(percent: int):
    """A class: the fragments' counts summed per partner, and the pairs that reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("a", "n", "partners", "counts")), strict=True))
        a, n, partners, sizes = next((a, n, np.frombuffer(p, np.int64), np.frombuffer(s, np.int64)) for a, n, p, s in rows if p is not None)
        total = np.zeros(len(partners), np.int64)
        for _, _, p, counts in rows:
            if p is None:
                total += np.frombuffer(counts, "<u4")
        near = 100 * total >= percent * (n + sizes - total)
        return pa.table({"a": pa.array(np.full(int(near.sum()), a), pa.int64()), "b": pa.array(partners[near]), "overlap": pa.array(total[near])})

    return run


def linked(live: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """``(a, b, overlap)`` of pairs that reach the threshold.

    ``partners(node, partners)`` lists the classes to compare each one with, as structs of node and size.
    """
    entries = live.agg(F.sum(F.length("keys") / 8).alias("n")).first()["n"] or 0
    fragments = max(MIN_FRAGMENTS, -(-int(entries) // FRAGMENT_ENTRIES))
    rows = live.select("node", "n", "keys").join(partners, "node", "left")
    segments = rows.mapInArrow(_segments_of_pairs(fragments), "frag int, node long, n long, keys binary, partners binary")
    partial = segments.groupBy("frag").applyInArrow(_partial_overlaps, "a long, n long, partners binary, counts binary")
    return partial.groupBy("a").applyInArrow(_sum_overlaps(percent), "a long, b long, overlap long")


def _candidates(percent: int):
    """A fragment of prefixes: for each class, those of other components that may have their first common n-gram here.

    All n-grams before the first common one, in the order of prefixes, are held by one side only.  So an n-gram at
    ``place`` of both sets can be the first one of a linked pair only if what follows it is enough for the threshold.
    """

    def run(table: pa.Table) -> pa.Table:
        key, node, n, label, place, side = (table.column(c).to_numpy() for c in ("key", "node", "n", "label", "place", "side"))
        ids, index, of = np.unique(node, return_index=True, return_inverse=True)
        n, label = n[index], label[index]
        order = np.argsort(key, kind="stable")
        postings = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        lists = np.empty(len(key), np.int64)
        lists[order] = np.repeat(np.arange(len(postings)), [len(p) for p in postings])
        by_node = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[by_node], np.arange(len(ids) + 1))
        out, cuts, held = [], [0], []
        for i in range(len(ids)):
            mine = by_node[begin[i] : begin[i + 1]]
            met = [postings[j] for j in lists[mine]]
            mine, met = np.repeat(mine, [len(p) for p in met]), np.concatenate(met)
            other = of[met]
            room = np.minimum(n[i] - place[mine], n[other] - place[met])
            fits = (other > i) & (label[other] != label[i]) & ((100 + percent) * room >= percent * (n[i] + n[other]))
            found = np.unique(other[fits & ((side[mine] != side[met]) | (side[mine] < 0))])
            if len(found):
                out.append(int(ids[i]))
                held.append(found)
                cuts.append(cuts[-1] + len(found))
        held = np.concatenate(held) if held else np.zeros(0, np.int64)
        partners = pa.StructArray.from_arrays([pa.array(ids[held], pa.int64()), pa.array(n[held], pa.int64())], names=["node", "n"])
        return pa.table({"node": pa.array(out, pa.int64()), "found": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), partners)})

    return run


def _dealt(entries: DataFrame) -> DataFrame:
    """``entries`` with ``key`` and ``side`` so that no key has more than about two blocks of ``POSTING`` rows.

    The classes of a key with more are cut into blocks; each pair of blocks, and each block alone, gets a key of its own.
    In a pair only classes of different sides meet; a block alone has side -1.
    """
    own = F.pmod(F.xxhash64("node", "key"), "blocks")
    cells = entries.withColumn("blocks", F.ceil(F.col("holders") / F.lit(POSTING))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return cells.select("node", "n", "label", "place", cell.alias("key"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("side"))


def _compared(live: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of linked pairs among ``partners(node, partners)``, all of them in ``live``."""
    return materialise(linked(live, partners, percent).select("a", "b"), "links")


def _mixed_entries(live: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, node, n, label, place, holders)`` of the prefix n-grams that classes of several components hold.

    ``place`` counts the n-grams of the class that come before, those that nobody else holds first.
    """
    unshared = F.col("n") - (F.length("keys") / 8).cast("long")
    labelled = live.withColumn("unshared", unshared).join(labels, "node", "left")
    entries = labelled.select("node", "n", F.coalesce("label", "node").alias("label"), "unshared", F.posexplode("prefix").alias("at", "key"))
    entries = entries.select("node", "n", "label", (F.col("unshared") + F.col("at")).alias("place"), "key")
    mixed = entries.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("holders")).filter("lo != hi").select("key", "holders")
    return materialise(entries.join(mixed, "key"), "prefix")


def _leaders(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """``(node, partners)``: for each class a few classes of other components, each one leading a prefix n-gram of it.

    An n-gram is led by the class of the smallest hash, another one in every round; sizes must fit.
    """
    lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")).alias("lead")
    met = entries.join(entries.groupBy("key").agg(lead), "key").filter("label != lead.label")
    fits = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    met = met.filter(fits).select("node", "lead.h", F.struct("lead.node", "lead.n").alias("p")).distinct()
    first = F.row_number().over(Window.partitionBy("node").orderBy("h"))
    return met.withColumn("__at", first).filter(F.col("__at") <= PARTNERS).groupBy("node").agg(F.collect_list("p").alias("partners"))


def _forest(labels: DataFrame) -> DataFrame:
    """``(a, b)``: one edge for each node, to the node that names its component; stands for all links found before."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def class_links(live: DataFrame, percent: int) -> DataFrame:
    """``(node, label)``: components of the classes under all links; see the module's third pass."""
    keyed = live.select("node", "n", F.posexplode("leaders").alias("turn", "least"))
    lead = keyed.groupBy("turn", "least").agg(F.min(F.struct("node", "n")).alias("lead"))
    stars = keyed.join(lead, ["turn", "least"]).filter("node != lead.node").groupBy("node").agg(F.collect_set("lead").alias("partners"))
    labels = components(_compared(live, stars, percent))
    entries = _mixed_entries(live, labels)
    for turn in range(ROUNDS):
        met = live.join(entries.select("node").distinct(), "node", "left_semi")
        found = _compared(met, _leaders(entries, percent, turn), percent)
        new = found.count()
        if new:
            labels = components(_forest(labels).union(found))
            entries = _mixed_entries(live, labels)
        if new * ENOUGH < live.count():
            break

    # What is still apart: every pair of different components that may have its first common n-gram in both prefixes.
    dealt = materialise(_dealt(entries), "dealt")
    fragments = max(MIN_FRAGMENTS, -(-dealt.count() // FRAGMENT_ENTRIES))
    found = dealt.groupBy(F.pmod("key", F.lit(fragments)).alias("frag")).applyInArrow(_candidates(percent), "node long, found array<struct<node:long,n:long>>")
    others = found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("partners"))
    still = live.join(entries.select("node").distinct(), "node", "left_semi")
    return components(_forest(labels).union(_compared(still, others, percent)))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, copies)`` for every row of ``docs``.

    Sets are the distinct runs of ``k`` lower-cased words, the whole sequence if there are fewer.  Two rows link when
    ``100 * intersection >= percent * union``; a component is named by its smallest id.  ``copies`` counts the rows with
    the same set.

    Null or blank texts have an empty set, link with nothing and are their own component.  Repeated rows are copies of
    each other.  A row without an id takes part; its component is named by the ids that exist, else it is null.  An
    empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    info = materialise(document_sets(docs, k, id_column, text_column), "sets")
    classes = info.filter("n > 0").groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("rep"), F.min("unshared").alias("unshared"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    left = classes.filter((100 * (F.col("n") - F.col("unshared")) >= percent * F.col("n")) & F.col("rep").isNotNull())
    wanted = left.select("rep", "n", "sig", "sig2")

    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).alias("text")).join(wanted, "rep")
    sets = texts.mapInArrow(_sets_of(k), "node long, n long, keys binary").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    fragments = partitions(docs.sparkSession)
    segments = sets.mapInArrow(_from_sets(fragments), SEGMENT)
    counted = segments.groupBy("frag").applyInArrow(_count_holders, "block long, docs binary, keys binary, counts binary, info binary")
    live = counted.groupBy("block").applyInArrow(_prefixes(percent), "node long, n long, keys binary, prefix array<long>, leaders array<long>")
    live = materialise(live, "live")

    labels = class_links(live, percent)
    named = labels.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    of_class = named.join(least, "label").select(F.col("node").alias("sig"), "least")
    resolved = classes.join(of_class, "sig", "left").select("n", "sig", "sig2", "copies", F.coalesce("least", "rep").alias("component_id"))
    return info.join(resolved, ["n", "sig", "sig2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of every component; of repeated ids one row stays.

    Rows without id can't be told apart and stay.
    """
    found = ngram_components(docs, k, percent, id_column, text_column)
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep")).distinct()
    with_id = docs.filter(F.col(id_column).isNotNull()).join(keep, F.col(id_column).cast("long") == F.col("__keep"), "left_semi").dropDuplicates([id_column])
    return with_id.union(docs.filter(F.col(id_column).isNull()))
