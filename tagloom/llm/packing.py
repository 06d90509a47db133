"""Packing of tokenised documents into fixed-length sequences by linear grouping.

The number of pieces of each length (at most ``capacity`` rows, whatever the corpus) is all that the plan needs.  Large
lengths are sorted and cut into groups of equal cardinality, each rounded up to its longest; configurations of these few
sizes are optimised by column generation over the linear relaxation; actual lengths then take the places of the rounded
ones, and small lengths go where they fit best.  The plan speaks of runs of equal sequences, so it stays small too.

Pieces get a rank within their length, distributed, and rank and length say where in the plan a piece stands.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from . import words
from .common import rank_in_groups

#: Words whose ids a task remembers (about 45 bytes each; new ones cost most of the time), and rounded sizes of the linear grouping.
CACHE, GROUPS = 2_000_000, 64
#: Lengths above this part of the capacity are large: grouped, rounded up and configured.
LARGE = 3

_tokenizers: dict = {}


#: A special token of the vocabulary; texts that may hold one are not taken word by word.
_MARK = "<|endoftext|>"
_LETTER, _MARK_BYTE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK_BYTE[[x for x in range(33, 127) if not chr(x).isalpha() and chr(x) != "'"]] = True


class _Encoder:
    """Ids of text word by word, for the lower-casing word vocabulary.

    That tokenizer drops white space and never joins across it, so a word's ids can be kept, by the word's 64-bit hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self.model.token_to_id(_MARK)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, new: list[bytes]) -> list[np.ndarray]:
        """Many words in one call, with a special token between them."""
        joined = np.array(self.model.encode(_MARK.join(w.decode() for w in new), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(joined == self.mark)
        if len(cuts) != len(new) - 1:
            return [np.array(self.model.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w in new]
        begin, end = [0, *(cuts + 1)], [*cuts, len(joined)]
        return [joined[a:b] for a, b in zip(begin, end, strict=True)]

    def learn(self, keys: np.ndarray, new: list[bytes]) -> None:
        ids = [x for first in range(0, len(new), 512) for x in self._ids(new[first : first + 512])]
        slots = len(self.bounds) - 1 + np.arange(len(new))
        self.flat = np.concatenate([self.flat, *ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids])])
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every text of a block (bytes and row offsets)."""
        if len(self.keys) > CACHE:
            self.clear()
        starts = _units(raw, offsets)
        hashes, rows = words.hashes_at(raw, starts), words.rows_of(starts, offsets)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.keys, assume_unique=True)
        if new.any():
            ends = np.append(starts[1:], len(raw))
            self.learn(distinct[new], [raw[starts[i] : ends[i]].tobytes().strip() for i in first[new]])
        slots = self.slots[np.searchsorted(self.keys, distinct)][at]
        begin, n = self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.concatenate([[0], stop])[np.searchsorted(rows, np.arange(len(offsets)))]
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for row in {int(r) for r in words.rows_of(_openings(raw), offsets)}:  # may hold a special token, whose case matters
            text = raw[offsets[row] : offsets[row + 1]].tobytes().decode()
            out[row] = np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def _units(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: words, also cut between an ASCII letter and an ASCII digit or mark next to it.

    The tokenizer always cuts there, too; an apostrophe, which may belong to either side, is no such mark.
    """
    letter, mark = _LETTER[raw], _MARK_BYTE[raw]
    start = np.zeros(len(raw), dtype=bool)
    start[words.word_starts(raw, offsets)] = True
    start[1:] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    return np.flatnonzero(start)


def _openings(raw: np.ndarray) -> np.ndarray:
    """Where ``<|`` stands."""
    at = np.flatnonzero(raw[:-1] == ord("<"))
    return at[raw[at + 1] == ord("|")]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = _Encoder(path)
        encoder = _tokenizers[path]
        for rows, raw, offsets in words.blocks(batches, size=1 << 21):
            out = []
            for row, ids in enumerate(encoder.encode(raw, offsets)):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity].tobytes()
                    out.append((row, piece, start, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            row, *rest = zip(*out, strict=True)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [rows.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns[: 6 if with_ids else 5], names=names[: 6 if with_ids else 5])

    return run


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; each document ends with ``end_id``; null text counts as empty."""
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return picked.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)


# -- the plan: from counts of lengths to runs of equal sequences --------------------------------------


def _best_pattern(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration of most value that fits (knapsack over capacity)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.argsort(-values / np.array(sizes)):
        s, v = sizes[i], values[i]
        if v <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):  # a stride of s at a time: several copies of one size add up
            hi = min(lo + s, capacity + 1)
            better = best[lo - s : hi - s] + v > best[lo:hi] + 1e-12
            best[lo:hi][better] = (best[lo - s : hi - s] + v)[better]
            choice[lo:hi][better] = i
    pattern: dict[int, int] = defaultdict(int)
    at = capacity
    while choice[at] >= 0:
        pattern[int(choice[at])] += 1
        at -= sizes[choice[at]]
    return float(sum(values[i] * n for i, n in pattern.items())), dict(pattern)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often to use each (rounded down), by column generation on the linear relaxation."""
    k = len(sizes)
    columns = [{i: min(capacity // s, max(1, demand[i]))} for i, s in enumerate(sizes)]
    basis = np.diag([float(c[i]) for i, c in enumerate(columns)])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        level = inverse @ need
        value, pattern = _best_pattern(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        enter = np.zeros(k)
        for i, n in pattern.items():
            enter[i] = n
        move = inverse @ enter
        ratio = np.where(move > 1e-9, np.maximum(level, 0) / np.where(move > 1e-9, move, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave], columns[leave] = enter, pattern
    level = np.linalg.inv(basis) @ need
    return [(c, int(n + 1e-6)) for c, n in zip(columns, level, strict=True) if n >= 1 - 1e-6]


class _Runs:
    """Runs of sequences with equal contents, by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], defaultdict(list)

    def add(self, count: int, content: list[tuple[int, int]]) -> None:
        room = self.capacity - sum(length * n for length, n in content)
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append((count, content))

    def best_fit(self, length: int, count: int) -> None:
        """Into the fullest sequences that have room, as many as each takes; new sequences for the rest."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                if count >= each:
                    self.add(count // each, [(length, each)])
                if count % each:
                    self.add(1, [(length, count % each)])
                return
            room = self.rooms[at]
            held, content = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(at)
            each = room // length
            whole = min(held, count // each)
            if whole:
                self.add(whole, [*content, (length, each)])
                count -= whole * each
                held -= whole
            if held and count:
                self.add(1, [*content, (length, count)])
                count, held = 0, held - 1
            if held:
                self.add(held, content)


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs ``(sequences, [(length, pieces of it in each)])`` that hold all pieces."""
    runs = _Runs(capacity)
    left = dict(counts)
    if full := left.pop(capacity, 0):
        runs.add(full, [(capacity, 1)])
    large = sorted((n for n in left if n > capacity // LARGE), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        per = max(1, -(-total // groups))
        stock: list[list[list[int]]] = []  # by group: [length, pieces], longest first
        held = per
        for length in large:
            n = left[length]
            while n:
                if held == per:
                    stock.append([])
                    held = 0
                take = min(n, per - held)
                stock[-1].append([length, take])
                held, n = held + take, n - take
        sizes = [g[0][0] for g in stock]
        merged: dict[int, list[list[int]]] = defaultdict(list)
        for s, g in zip(sizes, stock, strict=True):
            merged[s] += g
        sizes = list(merged)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [sizes[i] for i, n in sorted(pattern.items()) for _ in range(n)]
            while times and all(merged[s] for s in slots):
                need: dict[int, int] = defaultdict(int)  # places drawn from the run in front of each group
                for s in slots:
                    need[s] += 1
                m = min([times, *(merged[s][0][1] // n for s, n in need.items())])
                content: dict[int, int] = defaultdict(int)
                if m:
                    for s, n in need.items():
                        content[merged[s][0][0]] += n
                        merged[s][0][1] -= m * n
                else:  # one sequence across the end of a run
                    m = 1
                    if any(sum(r[1] for r in merged[s]) < n for s, n in need.items()):
                        break
                    for s, n in need.items():
                        for _ in range(n):
                            content[merged[s][0][0]] += 1
                            merged[s][0][1] -= 1
                            if not merged[s][0][1]:
                                merged[s].pop(0)
                for s in need:
                    if merged[s] and not merged[s][0][1]:
                        merged[s].pop(0)
                runs.add(m, sorted(content.items(), reverse=True))
                times -= m
        for n in large:
            left[n] = 0
        for g in merged.values():
            for length, n in g:
                left[length] += n
    for length in sorted(left, reverse=True):
        if left[length]:
            runs.best_fit(length, left[length])
    return [run for room in runs.rooms for run in runs.by_room[room]]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each, offset), sorted: where the pieces of a length go."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, content in runs:
        offset = 0
        for length, each in content:
            out.append((length, taken[length], sequence, each, offset))
            taken[length] += count * each
            offset += length * each
        sequence += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            within = rank - row[:, 1]
            kept = batch.select([c for c in batch.schema.names if c != "rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(row[:, 2] + within // row[:, 3]), pa.array(row[:, 4] + within % row[:, 3] * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` of every piece.

    Null and empty texts are the end id alone.  Repeated rows are packed as often as they occur; rows without id as well.
    An empty table gives no rows.  Other columns are ignored.  The driver sees one count for each length, at most
    ``capacity``, and sends tasks a plan whose size depends on the number of lengths, not on documents.
    """
    pieces = materialise(tokenised(docs, tokenizer_path, capacity, end_id, with_ids, id_column, text_column), "pieces")
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("group_rows"))
    counts = {r["length"]: r["group_rows"] for r in lengths.collect()}
    table = places(plan(counts, capacity))
    bounded = docs.sparkSession.createDataFrame(sorted(counts.items()), "length long, group_rows long")  # at most `capacity` rows
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = rank_in_groups(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.broadcast(bounded), spread)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInArrow(_place(table), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, from pieces packed with their ids (little-endian)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
