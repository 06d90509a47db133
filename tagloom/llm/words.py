"""Words of UTF-8 text as numpy arrays: boundaries, 64-bit hashes and shingle sets.

Helpers for tasks: they see one Arrow batch of texts, cut into blocks of a few megabytes, so memory does not depend on
how many rows a task reads.  A single text larger than a block is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
_STEP = 1 << 20

_seed = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between plain words: ASCII without letters and digits.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def _byte_values(lower: bool, gaps: np.ndarray) -> np.ndarray:
    """A random odd number for every byte; bytes between words count as nothing, A-Z as a-z if asked."""
    values = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[gaps] = 0
    return values


_LOWER, _EXACT, _PLAIN = _byte_values(True, _SPACE), _byte_values(False, _SPACE), _byte_values(True, _MARKS)
_ORDER = np.random.default_rng(78).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, 1), _powers(_BASE_INVERSE, 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * _STEP)
        _POWERS, _INVERSES = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _POWERS, _INVERSES


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, column: str = "text", size: int = BLOCK, most: int = 60_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows, first + most)
            yield (
                batch.slice(first, last - first),
                raw[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last


def word_starts(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> np.ndarray:
    """Where words begin; a word never crosses rows."""
    solid = ~gaps[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = solid[heads]
    return np.flatnonzero(start)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(rows_of(word_starts(raw, offsets), offsets), minlength=len(offsets) - 1)[: len(offsets) - 1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, kind: str = "lower") -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order; equal words have equal hashes wherever they stand.

    ``lower`` and ``exact`` words stand between white space; ``plain`` ones are lower-cased and free of ASCII marks.
    """
    starts = word_starts(raw, offsets, _MARKS if kind == "plain" else _SPACE)
    return hashes_at(raw, starts, kind), rows_of(starts, offsets)


def hashes_at(raw: np.ndarray, starts: np.ndarray, kind: str = "lower") -> np.ndarray:
    """Hash of what lies between each start and the next; bytes between words do not count."""
    values = {"lower": _LOWER, "exact": _EXACT, "plain": _PLAIN}[kind]
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, begin + _STEP, side="right")))
        end = int(starts[last]) if last < len(starts) else len(raw)
        powers, inverses = _tables(end - begin)
        local = starts[first:last] - begin
        weighted = values[raw[begin:end]] * powers[: end - begin]
        hashes[first:last] = np.add.reduceat(weighted, local) * inverses[local]
        first = last
    return mix(hashes)


def stems(raw: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of the first bytes of every plain word that is longer, for each of the lengths."""
    starts = word_starts(raw, offsets, _MARKS)
    rows, out, longest = rows_of(starts, offsets), [], max(lengths)
    inside = _PLAIN != 0
    total, alive = np.zeros(len(starts), np.uint64), np.ones(len(starts), dtype=bool)
    for i in range(longest + 1):
        at = np.minimum(starts + i, max(len(raw) - 1, 0))
        alive &= (starts + i < len(raw)) & inside[raw[at]] & (rows_of(at, offsets) == rows)
        if i in lengths:
            out.append((mix(total[alive] + np.uint64(i)), rows[alive]))
        total = total + _PLAIN[raw[at]] * _ORDER[i]
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``k`` words; a row with fewer words gives its whole sequence once."""
    counts = np.bincount(rows, minlength=n_rows)
    total = len(hashes)
    if total >= k:
        whole = rows[: total - k + 1] == rows[k - 1 :]
        mixed = hashes[: total - k + 1] * _ORDER[0]
        for i in range(1, k):
            mixed = mixed + hashes[i : total - k + 1 + i] * _ORDER[i]
        out, of = mix(mixed[whole]), rows[: total - k + 1][whole]
    else:
        out, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=rows.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for row in short:
            own = hashes[begin[row] : begin[row + 1]]
            extra.append(int((own * _ORDER[: len(own)]).sum(dtype=np.uint64)) + len(own))
        extra = mix(np.array([x & (2**64 - 1) for x in extra], dtype=np.uint64))
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """The sorted set of every row."""
    begin = np.searchsorted(rows, np.arange(n_rows + 1))
    return [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(n_rows)]
