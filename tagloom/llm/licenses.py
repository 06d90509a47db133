"""License scan: phrases, and an exact containment join between spans of words and license templates.

A span (a run of a document's words, whatever lines they stand on) matches a template if it holds at least ``threshold``
of the template's distinct words, and among them the words that tell the template from others (``MARKS``).  A span is as
long as the template, with room for inserted words: its number of words divided by ``threshold``.
A whole line is a span too, however many words are put in between.

Documents are cut into overlapping blocks, so that every span lies whole in the block in which it starts.  Words of all
templates are put in one order, the rarest in the corpus first.  A block with a matching span must hold a word of the
template's prefix (its first ``size - needed + 1`` words), must hold enough template words at all (length filter), and
the words after the first common one must suffice on both sides (positional filter); in what remains every span is
counted exactly.

Texts are read once: what goes on is the number of words, the template words of each document, and the few texts in
which a phrase or a whole template could stand.  Column expressions and joins only; templates are a bounded parameter.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise

#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0"),
]
#: Statements that run over several lines, and one that the templates lack.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]
#: Names of licenses; a span must hold those among its template's words.
MARKS = frozenset("mit apache gnu mozilla bsd cc nc".split())


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _places(words: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase's words stand one after another."""

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase)])

    last = F.size(words) - len(phrase)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = (*TEMPLATES, *NOTICES), threshold: float = 0.8,
    id_column: str = "doc_id", text_column: str = "text", marks: Collection[str] = MARKS,
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    ``base_labels`` come from phrases, ``labels`` from matching templates too; both distinct, sorted, joined by commas,
    empty if there are none.  ``score`` is the best containment that reached the threshold, 1 where a phrase stands, else
    0.  Null texts are empty.  Repeated rows are scanned alike; rows without id are kept.  An empty table gives no rows.
    Other columns are ignored.
    """
    sets = [(label, sorted(set(text.split())), max(1, ceil(len(text.split()) / threshold - 1e-9))) for label, text in templates]
    sets = [(label, words, max(1, ceil(threshold * len(words) - 1e-9)), width) for label, words, width in sets]
    marked = [[w for w in words if w in marks] for _, words, _, _ in sets]
    vocabulary = sorted({w for _, words, _, _ in sets for w in words})
    widest = max((width for *_, width in sets), default=1)

    lowered = F.lower(F.col("text"))
    found = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    maybe = "|".join(GAP.join(p.split()) for p in phrases) or "(?!)"
    read = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    read = read.select("doc_id", "text", F.size(found).alias("n_words"), F.array_intersect(_strings(vocabulary), found).alias("held"), lowered.rlike(maybe).alias("phrase"))
    holds = lambda words, n: F.size(F.array_intersect("held", _strings(words))) >= n
    enough = reduce(lambda a, b: a | b, [holds(words, need) & holds(own, len(own)) for (_, words, need, _), own in zip(sets, marked, strict=True)], F.lit(False))
    read = read.select("doc_id", F.xxhash64("text").alias("key"), F.col("n_words").cast("long").alias("n_words"), "held", "phrase", F.when(F.col("phrase") | enough, ascii_lower(F.col("text"))).alias("text"))
    read = materialise(read, "scan")

    counts = read.select(F.explode("held").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # at most the templates' words
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = [
        (word, number, label, at, len(words), need, ordered, width, marked[number])
        for number, (label, words, need, width) in enumerate(sets)
        for ordered in [sorted(words, key=place.__getitem__)]
        for at, word in enumerate(ordered[: len(words) - need + 1])
    ]
    prefixes = docs.sparkSession.createDataFrame(index, "word string, number int, label string, at int, size int, need int, template array<string>, width int, marks array<string>")

    kept = read.filter("text is not null").dropDuplicates(["doc_id", "key"])
    heard = kept.select("doc_id", "key", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(widest))
    blocks = heard.select("doc_id", "key", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, 2 * widest - 1))).alias("words"))
    blocks = blocks.withColumn("block", F.array_intersect(_strings(order), "words"))
    lines = kept.select("doc_id", "key", F.explode(F.split("text", "\n")).alias("line"))
    held = F.array_intersect(_strings(order), F.regexp_extract_all("line", F.lit(WORD), F.lit(0)))
    blocks = blocks.union(lines.select("doc_id", "key", F.lit(None).cast("array<string>"), held)).filter(F.size("block") > 0)
    candidates = blocks.select("doc_id", "key", "words", "block", F.posexplode("block").alias("place", "word")).join(F.broadcast(prefixes), "word")
    candidates = candidates.filter((F.size("block") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("block") - F.col("place") - 1) >= F.col("need")))
    common = F.array_intersect("template", "block")
    candidates = candidates.filter((F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word")) & (F.size(F.array_except("marks", "block")) == 0))
    places = F.filter(F.sequence(F.lit(0), F.least(F.size("words"), F.lit(widest)) - 1), lambda i: F.array_contains("template", F.get("words", i)))
    spans = F.transform(places, lambda i: F.array_intersect("template", F.slice("words", i + 1, F.col("width"))))
    most = F.array_max(F.transform(F.filter(spans, lambda x: F.size(F.array_except("marks", x)) == 0), lambda x: F.size(x)))
    most = F.when(F.col("words").isNull(), F.size(common)).otherwise(most)
    counted = candidates.select("doc_id", "key", "label", "size", "need", most.alias("most")).filter(F.col("most") >= F.col("need"))
    matches = counted.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max(F.col("most") / F.col("size")).alias("containment"))

    words = F.col("words")
    places = {p: F.col(f"at_{i}") for i, p in enumerate(phrases)}
    base = kept.filter("phrase").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    base = base.select("doc_id", "key", *[_places(words, p.split()).alias(f"at_{i}") for i, p in enumerate(phrases)])
    every = F.concat(*places.values()) if places else F.array().cast("array<int>")
    own = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in places.items()])) if places else _strings([])
    base = base.select(
        "doc_id", "key", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), own.alias("base"))

    result = read.select("doc_id", "key", "n_words").alias("r")
    for name, side in (("m", matches), ("b", base)):
        result = result.join(side.alias(name), F.col("r.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("r.key") == F.col(f"{name}.key")), "left")
    none = _strings([])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base_labels, more = F.coalesce("b.base", none), F.coalesce("m.more", none)
    return result.select(
        "r.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", labels(base_labels).alias("base_labels"),
        labels(F.concat(base_labels, more)).alias("labels"), F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
