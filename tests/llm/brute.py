"""Small documents with every awkward case, and plain Python versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, `key` int, label string, node int, size string"
ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéoü") for _ in range(rng.randint(2, 7))) for _ in range(n))


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), edits):
        words[i] = "X" + words[i]
    return " ".join(words)


def documents(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base, other, passage = prose(rng, 120), prose(rng, 90), prose(rng, 130)
    texts: list[str | None] = [base, base, base.upper().replace(" ", "  "), other, None, "", " \t\n", "one", "One two", "one  two", "three four five six"]
    texts += [near(rng, base, n) for n in (1, 1, 2, 3, 4, 5, 6, 8, 12)]  # from copies to strangers, chained through each other
    chain = other
    for _ in range(5):
        chain = near(rng, chain, 2)
        texts.append(chain)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    texts += ["ab" * 900, "ab" * 700, "z" * 1500, "é" * 600, prose(rng, 3000)]
    texts += [prose(rng, rng.randint(5, 60)) for _ in range(10)]
    rows = [(i * 7 % 101, t, "en", f"s{i % 4}" if i % 9 else None, None, "n", i, "label", i, "size") for i, t in enumerate(texts)]
    rows.append(rows[3])  # the same row again
    rows.append((None, "no id at all", None, None, None, None, None, None, None, None))
    return rows


def shingle_set(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def components(rows: list[tuple], percent: int = 75) -> Counter:
    """Of (doc_id, set size, smallest id of the component)."""
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(sets):
        root, known = find(i), least.get(find(i))
        least[root] = doc if known is None else known if doc is None else min(known, doc)
    return Counter((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def removal(rows: list[tuple], length: int) -> list[tuple[int | None, bytes, bytes, int]]:
    """(doc_id, bytes, bytes kept, removed runs) of every row."""
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen: Counter = Counter()
    for _, d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for doc, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, d, bytes(x for x, g in zip(d, gone, strict=True) if not g), runs))
    return out


def shares(sizes: dict[str | None, int], weights=(3, 1, 2), share: float = 1.5, cap: float = 2) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    total, open_ = share * sum(sizes.values()), set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def groups(pairs) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def trie(rows: list[tuple], group: int = 20, heads: int = 4) -> Counter:
    """Rows of the prefix trie for (conv_id, turn, role, text)."""
    import hashlib
    import zlib

    own = groups((c, (t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).digest(), x or "")) for c, t, r, x in rows if c is not None)
    own = {c: [(r, x) for *_, r, _, x in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        convs[c] = tuple(own.get(c - int(c % group if c >= 0 else -(-c % group)), [])[:h] + turns[h:])
    members = groups((turns[:d], c) for c, turns in convs.items() for d in range(len(turns) + 1))
    kids = groups((p[:-1], p) for p in members if p)
    size = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = (len(members[p]) - 1) * size(p) + sum(saved[k] for k in kids.get(p, []))
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha([c for c in m if len(convs[c]) == len(p)]))
        for p, m in members.items()
    )
