"""Classifiers on texts whose class is known, and their awkward cases."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm import quality, toxicity
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, label string, score double"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        text, bad = brute.prose(rng, 40), i % 4 == 0
        if bad:
            words = text.split()
            for w in rng.sample(["vileword", "badname", "cursed"], rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", "s", ","]))
            text = " ".join(words)
        rows.append((i, text, "x", 0.0))
        labels.append((i, int(not bad), int(bad)))
    rows += [(900, None, None, None), (901, "", None, None), (None, "vileword badname cursed", None, None), (0, *rows[0][1:])]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([r for r in labels if r[0] % 3] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert docs.count() == toxicity.toxicity(docs, labels.limit(0)).count()
    right = sum(got[i].predicted == (i % 4 == 0) for i in range(240))
    assert right >= 235
    assert got[None].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic for r in got.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_thresholds_are_ordered(corpus):
    _, cut = toxicity.model(*corpus, grades=4, most=1000)
    assert len(cut) == 3 and (cut[1:] >= cut[:-1]).all()


def test_quality(corpus):
    docs, labels = corpus
    found = quality.quality(docs, labels).collect()
    assert len(found) == docs.count()
    got = {r.doc_id: r for r in found}
    held = [i for i in range(240) if got[i].held_out]
    assert held and {r.doc_id for r in docs.filter("crc32(cast(doc_id as string)) % 5 = 0").collect()} == {i for i, r in got.items() if r.held_out}
    assert sum((got[i].score > 0.5) == (i % 4 != 0) for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert len({r.score for r in quality.quality(docs, labels.limit(0)).collect()}) == 1
    assert quality.quality(docs.limit(0), labels).count() == 0
