"""Filters and searches.  All of them are row-local predicates or semi-joins on the key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, normal, paths, tags as tg
from ..functions.binding import let
from ..functions.rules import Regex, java_regex

KEY = "image_key"


def by_category(df: DataFrame, categories: Sequence[str] | None, path: str = "image_path") -> DataFrame:
    """Records of the given categories; an empty selection means all."""
    return df.filter(paths.category(F.col(path)).isin(list(categories))) if categories else df


def _pattern_hit(terms: Column, pattern: str, regex: bool) -> Column:
    if regex:
        anchored = r"(?Ui)\A(?:" + java_regex(pattern.replace(" ", "_")) + ")"
        return F.exists(terms, lambda t: t.rlike(anchored))
    return F.array_contains(terms, normal.underscore_form(F.lit(pattern)))


def tag_condition(
    terms: Column,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_condition: str = "any",
    exclude_condition: str = "any",
    joiner: str = "and",
    regex: bool = False,
) -> Column:
    """Tag search predicate over ``functions.derived.search_terms``.

    An empty include list includes nothing, so exclude-only searches join with ``or``; ``all`` with an absent
    tag is false; an empty exclude list excludes nothing.
    """

    def combine(bound: Column, patterns: Sequence[str], condition: str) -> Column:
        hits = [F.coalesce(_pattern_hit(bound, p, regex), F.lit(False)) for p in patterns]
        if not hits:
            return F.lit(False)
        return reduce((lambda a, b: a | b) if condition == "any" else (lambda a, b: a & b), hits)

    def test(bound: Column) -> Column:
        included, kept = combine(bound, include, include_condition), ~combine(bound, exclude, exclude_condition)
        return included & kept if joiner == "and" else included | kept

    # Bound once: a filter is pushed below the projection that defines the terms, one copy per mention.
    return let(terms, test)


def by_tags(df: DataFrame, terms: str = "terms", **options) -> DataFrame:
    return df.filter(tag_condition(F.col(terms), **options))


def by_index(
    df: DataFrame,
    index: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_condition: str = "any",
    exclude_condition: str = "any",
    joiner: str = "and",
    regex: bool = False,
    key: str = KEY,
) -> DataFrame:
    """The same tag search over an inverted index ``(tag, key)``, for many searches on one stored index.

    Only index rows of the asked tags are read; per key they shrink to one flag per pattern map-side.  Records are
    found by semi-join, or by left join where records without any hit may match.
    """

    def hit(pattern: str) -> Column:
        if regex:
            return F.col("tag").rlike(r"(?Ui)\A(?:" + java_regex(pattern.replace(" ", "_")) + ")")
        return F.col("tag") == normal.underscore_form(F.lit(pattern))

    def combine(flags: list[Column], condition: str) -> Column:
        if not flags:
            return F.lit(False)
        return reduce((lambda a, b: a | b) if condition == "any" else (lambda a, b: a & b), flags)

    patterns = [*include, *exclude]
    if not patterns:
        return df if joiner == "or" else df.limit(0)
    names = [f"__p{i}" for i in range(len(patterns))]
    flags = index.filter(combine([hit(p) for p in patterns], "any")).groupBy(key).agg(
        *[F.max(hit(p)).alias(n) for p, n in zip(patterns, names)]
    )
    found = [F.coalesce(F.col(n), F.lit(False)) for n in names]
    included = combine(found[: len(include)], include_condition)
    kept = ~combine(found[len(include) :], exclude_condition)
    if joiner == "and":
        return df.join(flags.filter(included & kept).select(key), key, "left_semi")
    return df.join(flags, key, "left").filter(included | kept).drop(*names)


def by_quality(df: DataFrame, qualities: Sequence[str] | None, tags: str = "tags") -> DataFrame:
    """Records with one of the quality words; an empty selection means captioned records without quality."""
    word = dv.quality(F.col(tags))
    if not qualities:
        return df.filter(F.col(tags).isNotNull() & word.isNull())
    return df.filter(word.isin([q.lower() for q in qualities]))


def by_score(df: DataFrame, low: float | None = None, high: float | None = None, score: str = "aesthetic_score") -> DataFrame:
    """Scores within both bounds, inclusive; without bounds all records, also those without a score."""
    if low is None and high is None:
        return df
    condition = F.col(score).isNotNull()
    if low is not None:
        condition &= F.col(score) >= low
    if high is not None:
        condition &= F.col(score) <= high
    return df.filter(condition)


def by_key(df: DataFrame, keys: Sequence[str] | DataFrame, regex: bool = False, key: str = KEY) -> DataFrame:
    """Records by key: a literal list, regexes anchored at the start, or a table of keys (semi-join)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    if regex:
        return df.filter(tg.matches(F.col(key), [Regex(k) for k in keys]))
    return df.filter(F.col(key).isin(list(keys)))


def complement(scope: DataFrame, result: DataFrame, key: str = KEY) -> DataFrame:
    """Records of the scope that are not in the result."""
    return scope.join(result.select(key), key, "left_anti")


def query(scope: DataFrame, condition: Column, negate: bool = False) -> DataFrame:
    """Run a predicate on a scope (all records or a subset), or its complement within the scope."""
    hit = F.coalesce(condition, F.lit(False))
    return scope.filter(~hit if negate else hit)


def existing_files(df: DataFrame, listing: DataFrame, path: str = "image_path") -> DataFrame:
    """Records whose file is in a listing (``image_path``)."""
    return df.join(listing.select(F.col("image_path").alias(path)).distinct(), path, "left_semi")


def posts_with_all_tags(posts: DataFrame, tag_dim: DataFrame, names: Sequence[str]) -> DataFrame:
    """Posts whose ``tag_ids`` hold an id of each given tag name; an unknown name is an error."""
    wanted = sorted(set(names))
    rows = tag_dim.filter(F.col("name").isin(wanted) & F.col("id").isNotNull()).groupBy("name").agg(F.collect_set("id").alias("ids")).collect()
    if unknown := set(wanted) - {r.name for r in rows}:
        raise KeyError(f"unknown tag names: {', '.join(sorted(unknown))}")
    hits = [F.arrays_overlap("tag_ids", F.array(*[F.lit(i).cast("bigint") for i in r.ids])) for r in rows]
    return posts.filter(F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))) if hits else posts
