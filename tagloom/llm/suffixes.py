"""Suffix sorting in linear grouping steps."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order (a suffix sorts before its own extensions).

    First the suffixes are grouped by their Lyndon prefix, the longest Lyndon word they begin with.  Groups start as
    equal first symbols and are processed in descending order.  A suffix of the processed group ends the prefix found so
    far of the nearest smaller suffix before it, so that one's group is split: followed by more repeats of the processed
    prefix means larger.  Pointers to the previous smaller suffix skip everything already processed.

    Then the order within groups follows from the order of what comes after the Lyndon prefixes: going through the
    sorted suffixes from the smallest, each one places the suffixes whose prefix it ends, the chain of previous-smaller
    pointers before it, at the front of their groups.  Nothing is renamed or sorted again.
    """
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # position in `order`
    start = [0] * n  # by suffix: first position of its group
    size = {}  # by first position: suffixes in the group
    length = {}  # by first position: length of the common prefix
    first = 0
    for k, s in enumerate(order):
        place[s] = k
        if text[s] != text[order[first]]:
            first = k
        start[s] = first
        size[first] = size.get(first, 0) + 1
        length[first] = 1

    previous = [-1] * n
    end = n
    while end > 0:
        lo = start[order[end - 1]]
        members = order[lo:end]
        if len(members) > 1:
            members.sort()
        run = length[lo]
        repeats: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and place[p] >= lo:  # not smaller than this group
                p = previous[p]
            previous[s] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        if repeats:
            by_count: dict[int, list[int]] = {}
            for p, c in repeats.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                touched: dict[int, int] = {}
                for p in by_count[c]:
                    g = start[p]
                    k = g + size[g] - 1 - touched.get(g, 0)
                    touched[g] = touched.get(g, 0) + 1
                    q, at = order[k], place[p]  # to the end of what is left of its group
                    order[k], order[at] = p, q
                    place[p], place[q] = k, at
                for g, m in touched.items():
                    new = g + size[g] - m
                    longer = length[g] + c * run
                    if new != g:
                        size[g] -= m
                        for k in range(new, new + m):
                            start[order[k]] = new
                        size[new] = m
                    length[new] = longer
        end = lo

    front = {g: g for g in size}
    out = [-1] * n
    placed = [False] * n

    def put(s: int) -> None:
        while s >= 0 and not placed[s]:
            g = start[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = previous[s]

    put(n - 1)  # the end of the text is smaller than every suffix
    for k in range(n):
        put(out[k] - 1)
    return out
