"""BPE against the tokenizer library, the filter audit and the prefix trie against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tagloom.llm import bpe, filter_audit, prefix_trie, queries
from tests.llm import brute

PATH = queries.tokenizer_path(queries.BYTE_TOKENIZER)
ALPHABET = "a b  \n\t'sreTHe é漢1234=-\u0085​😀 ࢏\U000323b0"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(PATH))


def same(codec, library, text):
    ids = codec.encode(text)
    return np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(ALPHABET, max_size=60))
def test_random_texts(codec, library, text):
    assert same(codec, library, text)


def test_awkward_texts(codec, library, monkeypatch):
    rng = random.Random(2)
    mark = "<|endoftext|>"
    texts = ["", " ", "  ", "a  ", f"a {mark} b", mark * 2, f"x{mark}  \n", "a" * 20_000, " " * 5000, "=" * 777, "don't we'll IT'S 'tis"]
    texts += [rng.choice("=-a .é") * rng.randint(1, 900) for _ in range(50)]
    assert all(same(codec, library, t) for t in texts)
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    assert all(same(codec, library, "".join(rng.choice(ALPHABET) for _ in range(400))) for _ in range(60))


def test_full_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    small, rng = bpe.Codec(bpe.read_spec(PATH)), random.Random(3)
    assert all(same(small, library, brute.prose(rng, 80)) for _ in range(5))


def test_pieces_of_every_character(codec, library):
    """Classes of letters, numbers and white space are those of the library."""
    for first in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        ends = list(itertools.accumulate(map(len, codec.cut(text))))
        assert ends == [e for _, (_, e) in library.pre_tokenizer.pre_tokenize_str(text)], hex(first)


def test_round_trip(docs, rows, empty, library):
    got = Counter(map(tuple, bpe.round_trip(docs, PATH).collect()))
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")
        want[doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.read_spec(queries.tokenizer_path(queries.WORD_TOKENIZER))


def test_decoding_cut_characters(spark, codec):
    ids = np.frombuffer(codec.encode("é漢"), "<u4")
    tokens = spark.createDataFrame([(1, bytearray(ids[:1].tobytes())), (2, None), (None, bytearray(ids.tobytes()))], "doc_id long, ids binary")
    want = {1: codec.decode(ids[:1].tobytes()).decode("utf-8", "replace"), 2: "", None: "é漢"}
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()} == want


# -- filters --------------------------------------------------------------------------------------------


def fails_of(rows):
    least: dict = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, _, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        capitals = sum("A" <= c <= "Z" for c in t)
        copy = doc is not None and doc > least[t]
        yield doc, source or "", {x for x, f in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * capitals > 5 * len(t), any(c in "#$%&*|" for c in t), copy], strict=True) if f}


def audited(rows, labels):
    good, toxic = ({d for d, *y in labels if d is not None and y[i] == 1} for i in (0, 1))
    parts, shapley, out = defaultdict(list), Counter(), []
    for doc, part, fails in fails_of(rows):
        parts[part].append((doc, fails))
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                failing = sum(x in f for _, f in held)
                shapley[part, x] += len(gone)
                out.append((part, "".join(order), step, x, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in held), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
    return Counter((*r, shapley[r[0], r[3]]) for r in out)


def test_audit(spark, docs, rows, empty):
    rng = random.Random(6)
    extra = [(500 + i, rng.choice(["WORDS " * 60, "a # b", "clean words of some text " * 3, brute.prose(rng, 60), "ÀÉ" * 9 + "A"]), None, rng.choice(["", None, "s1", "new"]), *[None] * 6) for i in range(80)]
    extra += [(500, "other text under the same id", None, "s1", *[None] * 6), (None, "a # b", None, "s1", *[None] * 6)]
    every = rows + extra
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(400, 600)] + [(None, 1, 1), (510, 1, 0), (510, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark.createDataFrame(every, brute.SCHEMA).repartition(3), marks)
    assert Counter(map(tuple, got.collect())) == audited(every, labels)
    assert filter_audit.audit(empty, marks).count() == 0


def test_orders_by_adjacent_swaps():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.adjacent_swaps(n):
            order[i : i + 2] = order[i : i + 2][::-1]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == max(1, math.factorial(n))


# -- prefixes -------------------------------------------------------------------------------------------

TALK = "conv_id bigint, turn bigint, role string, text string, place string, x int"


def talks(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in range(-25, 60):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            turn = None if rng.random() < 0.05 else t if rng.random() < 0.9 else rng.randint(0, 3)
            role = rng.choice(["u", "a", None]) if rng.random() < 0.2 else "u"
            rows.append((c, turn, role, rng.choice(["x y", "x  y z", "", None, "q"]) if rng.random() < 0.3 else "same words"))
    for c in (3, 45, 57):
        rows += [(c, 100 + i, "u", f"deep {i}") for i in range(30)]
    return [(*r, "other", 1) for r in [*rows, rows[5], (None, 1, "u", "no conversation")]]


@pytest.mark.parametrize("cells", [32, 1 << 26])
def test_trie(spark, monkeypatch, cells):
    """Also with windows and pieces so short that they are carried on, and a sketch so small that it proves little."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 32)
    rows = talks(cells)
    got = prefix_trie.trie(spark.createDataFrame(rows, TALK).repartition(3), most_cells=cells)
    assert Counter(map(tuple, got.collect())) == brute.trie([r[:4] for r in rows])


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "u", f"turn {t}", "", 1) for c in range(0, 900) for t in range(3)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TALK).repartition(3))
    assert Counter(map(tuple, got.collect())) == brute.trie([r[:4] for r in rows])
    assert prefix_trie.trie(spark.createDataFrame([], TALK)).count() == 0
