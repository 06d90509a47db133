"""Operators over documents against plain Python, on all awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import fingerprints, licenses, mixing, ngram_join, packing, queries, substrings
from tests.llm import brute


def test_ngram_components(docs, rows, empty):
    got = ngram_join.ngram_components(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.components(rows)
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    least = {c for _, _, c in brute.components(rows)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c in least if c is not None)


@pytest.mark.parametrize("posting", [4000, 7])
def test_large_near_copy_group(spark, monkeypatch, posting):
    """Also with prefix n-grams dealt to pairs of blocks."""
    monkeypatch.setattr(ngram_join, "POSTING", posting)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0 if posting == 7 else 6)
    rng = __import__("random").Random(1)
    base = brute.prose(rng, 80)
    rows = [(i, brute.near(rng, base, rng.choice([0, 1, 1, 2, 3, 3, 4])), None, None, None, None, None, None, None, None) for i in range(120)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, brute.SCHEMA).repartition(4))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.components(rows)


def test_links_of_a_near_copy_group_grow_with_its_size(spark, monkeypatch):
    """Members that miss the leaders of their minimum hashes are brought together in rounds, not in pairs."""
    counted, compared = [], ngram_join._compared

    def count(*args):
        links = compared(*args)
        counted.append(links.count())
        return links

    monkeypatch.setattr(ngram_join, "_compared", count)
    for n in (120, 240):
        counted.clear()
        rng = __import__("random").Random(n)
        base = brute.prose(rng, 80)
        rows = [(i, brute.near(rng, base, 1 if rng.random() < 0.1 else 2), *[None] * 8) for i in range(n)]
        got = ngram_join.ngram_components(spark.createDataFrame(rows, brute.SCHEMA).repartition(4))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.components(rows)
        assert sum(counted) <= ngram_join.PARTNERS * n


def test_a_common_passage_makes_few_candidates(spark, monkeypatch):
    """Near copies in pairs, and half of every text is the same passage: only pairs with room for the overlap are compared."""
    listed, compared = [], ngram_join._compared

    def count(live, partners, percent):
        listed.append(partners.agg(F.sum(F.size("partners"))).first()[0] or 0)
        return compared(live, partners, percent)

    monkeypatch.setattr(ngram_join, "_compared", count)
    rng = __import__("random").Random(8)
    passage, n = brute.prose(rng, 60), 150
    rows = []
    for i in range(n):
        own = brute.prose(rng, 50)
        rows += [(2 * i + j, f"{text} {passage}", *[None] * 8) for j, text in enumerate((own, brute.near(rng, own, 1)))]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, brute.SCHEMA).repartition(4))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.components(rows)
    assert listed[-1] <= n


@pytest.mark.parametrize("hot", [0, 10**6])
def test_repeated_bytes(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "HEAVY", 20 if hot else 1000)  # some keys heavy, or all of these few rows
    want = Counter((d, len(b), len(b) - len(k), n, hashlib.sha256(k).hexdigest()) for d, b, k, n in brute.removal(rows, 400))
    assert Counter(map(tuple, substrings.removal_summary(docs).collect())) == want
    if hot:
        assert substrings.removal_summary(empty).count() == 0
        cut = substrings.without_repeats(docs)
        assert cut.columns == docs.columns
        texts = Counter((d, k.decode(errors="ignore")) for d, _, k, _ in brute.removal(rows, 400))
        assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == texts


def test_long_text_in_segments(monkeypatch):
    import pyarrow as pa

    text = brute.prose(__import__("random").Random(4), 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["text_key", "text"])

    def windows():
        out = []
        for b in substrings._stretch_rows(400)([batch]):
            for r in b.to_pylist():
                out += [(w, r["anchor"], r["at"]) for w in range(r["first"], r["last"] + 1)]
        return sorted(out)

    whole = windows()
    monkeypatch.setattr(substrings, "_SEGMENT", 3000)
    assert windows() == whole and len(whole) == len(text.encode()) - 399


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = brute.shares(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    by_target = {round(target[s], 6): s for s in target}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[by_target[round(r.target, 6)]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(5, 0.02 * t), s
    again = mixing.mix(docs.repartition(5)).collect()
    plain = lambda rs: Counter((r.doc_id, r.size, r.source_size, r.target, r.taken, r.copies, round(r.rate, 9)) for r in rs)
    assert plain(got) == plain(again)
    assert mixing.mix(empty).count() == 0
    repeats = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    single = [r for r in got if r.doc_id is not None and sum(x.doc_id == r.doc_id for x in got) == 1]
    assert all(repeats[r.doc_id] == r.copies for r in single)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    model = Tokenizer.from_file(path)
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = packing.pack(docs, path, capacity=512, with_ids=True)
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = brute.groups((r.sequence_id, (r.offset, r.length, bytes(r.ids))) for r in got)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for sequence, parts in held.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512 and whole[sequence] == b"".join(ids for *_, ids in sorted(parts))
    assert len(held) <= 1.08 * sum(r.length for r in got) / 512 + 1
    assert packing.pack(empty, path).count() == 0


def test_special_words_encode_as_the_library_does():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    model, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    texts = ["A <|endoftext|>b C<|startoftext|> <|ENDOFTEXT|>", "it's IT'S don't", "é  x y ΣΑΣ İ", "12,3.5!!! ...", ""]
    data = [t.encode() for t in texts]
    found = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert [e.tolist() for e in found] == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [16, 100, 4096])
def test_plan_holds_everything(capacity):
    rng = np.random.default_rng(capacity)
    for spread in (1.0, 0.3):
        counts = Counter(np.clip((rng.random(3000) ** 2 * spread * capacity).astype(int) + 1, 1, capacity).tolist())
        runs = packing.plan(dict(counts), capacity)
        held = Counter()
        for n, content in runs:
            assert sum(length * k for length, k in content) <= capacity
            for length, k in content:
                held[length] += n * k
        assert held == counts
        assert sum(n for n, _ in runs) <= 1.02 * (sum(k * v for k, v in counts.items()) / capacity) + 2
    assert packing.plan({}, capacity) == []


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = brute.groups(((r.doc_id, r.n_chars, r.edited_sha256), r) for r in fingerprints.fingerprint_documents(docs).collect())
    prints = {}
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        row = got[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()].pop()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        if edited == text:
            assert row.near_edited == 1.0
    assert not any(got.values())
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_estimate_generalised_jaccard():
    rng = __import__("random").Random(2)
    a = [brute.prose(rng, 200) for _ in range(40)]
    b = [brute.near(rng, t, 30) for t in a]
    found = fingerprints.fingerprints([t.encode() for t in a + b])
    pairs = lambda t: Counter(zip(t.lower().split(), t.lower().split()[1:]))
    true = [sum((pairs(x) & pairs(y)).values()) / sum((pairs(x) | pairs(y)).values()) for x, y in zip(a, b)]
    assert abs(fingerprints.likeness(found[:40], found[40:]).mean() - np.mean(true)) < 0.03
    weighted = [b"a b a b a b c d", b"a b c d c d c d"]
    one, two = fingerprints.fingerprints(weighted)
    assert 0.2 < (one == two).mean() < 0.7


def test_long_texts_are_not_alike_by_chance():
    one, two = (" ".join(f"{side}{i}" for i in range(100_000)).encode() for side in "ab")
    found = fingerprints.fingerprints([one, two, one])
    assert (found[0] == found[1]).mean() < 0.05 and (found[0] == found[2]).all()


def test_licenses(spark, empty):
    texts = [
        "Released under the MIT License.", "mit license MIT-License; mit\nlicense", "GENERAL PUBLIC license general public", "mitlicense mit licenses",
        "text\nThis work is licensed under the GNU General Public License, version 3.\nmore", "Licensed under CC BY-NC 4.0.", None, "", "é mit license é",
        "this work is licensed under the gnu general license version", "licensed cc by nc", "x " * 5000 + "Apache License",
    ]
    rows = [(i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], *[None] * 8), (None, "MIT license", *[None] * 8)]
    got = licenses.scan(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert len(got) == len(rows)
    pattern = re.compile(licenses.WORD)
    for r in got:
        text = "MIT license" if r.doc_id is None else texts[r.doc_id] or ""
        words = pattern.findall(text.translate(brute.ASCII_LOWER))
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        more, score = set(), 0.0
        for line in text.translate(brute.ASCII_LOWER).split("\n"):
            held = set(pattern.findall(line))
            for label, template in licenses.TEMPLATES:
                size = len(set(template.split()))
                common = len(held & set(template.split()))
                if common >= 0.8 * size - 1e-9:
                    more, score = more | {label}, max(score, common / size)
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want
    assert licenses.scan(empty).count() == 0


def test_licenses_across_lines(spark):
    wrapped = {
        "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that",
        "mpl": "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy of the MPL was not\n# distributed with this file, You can obtain one at\n# http://mozilla.org/MPL/2.0/.",
        "mit": "The above copyright notice and this permission notice shall be included\nin all copies or substantial portions of the Software.",
        "apache": "You may not use this file\nexcept in compliance with the License. You may obtain a copy of\nthe License at http://www.apache.org/licenses/LICENSE-2.0",
    }
    alone = {"Released under the BSD license.": "bsd", "Licensed under CC BY 4.0.": "", "Released under the same license.": "", "the license\n" + "x " * 400 + "\nreleased under mit": ""}
    alone |= {"Released under the terms and conditions of the well known MIT style license": "mit"}
    texts = [(t, label) for label, t in wrapped.items()] + [("word " * n + "\n" + wrapped["mpl"] + "\nword" * n, "mpl") for n in range(60, 180, 7)] + list(alone.items())
    rows = [(i, t, *[None] * 8) for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert [got[i].labels for i in range(len(texts))] == [label for _, label in texts]
    assert got[1].score == 1.0


def test_licenses_stay_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_components_do_not_gather_links_of_all_rounds(spark, monkeypatch):
    """Links found before stand as one edge a class, however many partners each class has met."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"x{i}", f"y{i}"])) for i in range(60)]
    edges, found, labels = [], [], []
    components, compared = ngram_join.components, ngram_join._compared

    def count_edges(links):
        edges.append(links.count())
        out = components(links)
        labels.append(out.count())
        return out

    def count_found(*args):
        out = compared(*args)
        out = out.union(out)  # as if every class had met twice as many partners
        found.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "components", count_edges)
    monkeypatch.setattr(ngram_join, "_compared", count_found)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}
    assert found[0] > labels[0] and len(edges) > 1  # gathered, they would be more than one a class
    assert edges[-1] <= labels[-2] + found[-1]
