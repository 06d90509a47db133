"""Regex search through the vocabulary of an inverted index.

A pattern is tested once per distinct tag instead of once per index row, and only on tags that hold the character trigrams
the pattern needs; then only the index rows of the tags that match are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import java_regex
from ..runtime import collect_if_small, explode_rows

KEY = "image_key"
#: Up to so many matching tags are put into the filter of the index scan; more are joined.
LISTED = 1000


def vocabulary(index: DataFrame) -> DataFrame:
    """``(tag, n, grams)``: every tag with its number of index rows and its distinct trigrams, lower-cased.

    Tags with characters outside ASCII, whose case rules are not one to one, have null grams and are always tested.
    """
    low = F.lower("tag")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("tag") - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    counted = index.filter("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("grams", F.when(~F.col("tag").rlike(r"[^\x00-\x7F]"), grams))


def gram_postings(words: DataFrame) -> DataFrame:
    """``(gram, tag)`` of a vocabulary; tags that are always tested stand under a null gram."""
    none = F.array(F.lit(None).cast("string"))
    return words.select(F.explode(F.coalesce("grams", none)).alias("gram"), "tag")


def _class_end(pattern: str, at: int) -> int:
    """Index after a character class that opens at ``at``."""
    at += 2 if pattern[at + 1 : at + 2] == "^" else 1
    first = True
    while at < len(pattern) and (pattern[at] != "]" or first):
        at += 2 if pattern[at] == "\\" else 1
        first = False
    return at + 1


def _group_end(pattern: str, at: int) -> int:
    """Index after a group that opens at ``at``."""
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
            continue
        if pattern[at] == "[":
            at = _class_end(pattern, at)
            continue
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        at += 1
        if not depth:
            break
    return at


def required_runs(pattern: str) -> list[str]:
    """Texts that every match of a pattern holds, lower-cased; groups, classes and repeated parts are passed over.

    Nothing is required of patterns with alternatives outside of groups, look-around, comments or flags.
    """
    if "(?" in pattern.replace("(?:", ""):
        return []
    runs, held, at = [], "", 0

    def close(drop: int = 0) -> str:
        runs.append(held[: len(held) - drop])
        return ""

    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            return []
        if c in "*?{":
            count = re.compile(r"\{\d*,?\d*\}").match(pattern, at)
            held, at = close(1), count.end() if count else at + 1
        elif c == "+":
            held, at = close(), at + 1
        elif c in ".^$)":
            held, at = close(), at + 1
        elif c == "[":
            held, at = close(), _class_end(pattern, at)
        elif c == "(":
            held, at = close(), _group_end(pattern, at)
        elif c == "\\":
            escaped = pattern[at + 1 : at + 2]
            if escaped and not escaped.isalnum() and escaped.isascii():
                held += escaped
            else:
                # A class or a border ends a run; after a code of several characters or a reference nothing is sure.
                held = close()
                if escaped not in set("dDwWsSbBAZ"):
                    return []
            at += 2
        elif c.isascii():
            held, at = held + c, at + 1
        else:
            held, at = close(), at + 1
    close()
    return [r.lower() for r in runs]


def required_grams(pattern: str) -> list[str]:
    """Trigrams of what a pattern requires."""
    return sorted({r[i : i + 3] for r in required_runs(pattern) for i in range(len(r) - 2)})


def candidates(words: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    """``(tag)`` of the vocabulary that hold every required trigram, or must be tested anyway."""
    grams = required_grams(pattern.replace(" ", "_"))
    if not grams:
        return words.select("tag")
    held = postings.filter(F.col("gram").isin(grams)).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return held.select("tag").union(postings.filter("gram is null").select("tag"))


def _matching(words: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    anchored = r"(?Ui)\A(?:" + java_regex(pattern.replace(" ", "_")) + ")"
    return candidates(words, postings, pattern).filter(F.col("tag").rlike(anchored))


def by_vocabulary(
    df: DataFrame,
    index: DataFrame,
    words: DataFrame,
    postings: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_condition: str = "any",
    exclude_condition: str = "any",
    joiner: str = "and",
    key: str = KEY,
    listed: int = LISTED,
) -> DataFrame:
    """The regex search of ``search.by_index`` with ``words`` and ``postings`` of the same index; the result is the same.

    Patterns are anchored at the start, without regard to case; blanks stand for underscores.
    """
    patterns = [*include, *exclude]
    if not patterns:
        return df if joiner == "or" else df.limit(0)
    names = [f"__p{i}" for i in range(len(patterns))]
    hits = [_matching(words, postings, p).select("tag", *[F.lit(i == j).alias(n) for j, n in enumerate(names)]) for i, p in enumerate(patterns)]
    tags = reduce(lambda a, b: a.union(b), hits).groupBy("tag").agg(*[F.max(n).alias(n) for n in names])
    small = collect_if_small(tags, listed)
    if small is None:
        rows = index.join(tags, "tag")
    else:
        asked = index.filter(F.col("tag").isin([r["tag"] for r in small]))
        rows = asked.withColumns({n: F.col("tag").isin([r["tag"] for r in small if r[n]]) for n in names})
    flags = rows.groupBy(key).agg(*[F.max(n).alias(n) for n in names])

    def combine(part: Sequence[str], condition: str) -> Column:
        found = [F.coalesce(F.col(n), F.lit(False)) for n in part]
        return reduce((lambda a, b: a | b) if condition == "any" else (lambda a, b: a & b), found) if found else F.lit(False)

    included, kept = combine(names[: len(include)], include_condition), ~combine(names[len(include) :], exclude_condition)
    if joiner == "and":
        return df.join(flags.filter(included & kept).select(key), key, "left_semi")
    return df.join(flags, key, "left").filter(included | kept).drop(*names)
