"""Tag statistics, the inverted index and dataset reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import derived as dv, normal, paths, tags as tg
from ..functions.rules import Regex, loose
from ..runtime import collect_if_small, explode_rows


def inverted_index(df: DataFrame, style_tags: Sequence[str] = (), typed: str = "typed", key: str = "image_key") -> DataFrame:
    """``(tag, key, is_artist, is_character, is_style)``, one row per distinct tag of a record.

    Duplicates are removed inside the row, because keys are unique: no shuffle.
    """
    entries = explode_rows(df, [key], dv.index_terms(F.col(typed), style_tags), "e")
    return entries.select("e.tag", key, "e.is_artist", "e.is_character", "e.is_style")


def term_index(df: DataFrame, style_tags: Sequence[str] = (), tags: str = "tags", key: str = "image_key") -> DataFrame:
    """``(tag, key)``: the same index without types, straight from the tags; no dictionary is looked up."""
    return explode_rows(df, [key], dv.search_terms(F.col(tags), style_tags), "tag").select("tag", key)


def keys_per_tag(index: DataFrame, tags: Sequence[str], key: str = "image_key") -> DataFrame:
    """Rows of the index for the given tags; kept long, so a hot tag stays spread over partitions."""
    return index.filter(F.col("tag").isin(list(tags))).select("tag", key)


def tag_frequency(index: DataFrame, threshold: int = 1, kind: str | None = None) -> DataFrame:
    """``(tag, n)``: number of records per tag, at least ``threshold``; ``kind`` keeps tags of one type.

    Index rows are distinct per record, so a plain count with map-side partial sums is exact.
    """
    typed = [F.max(f"is_{kind}").alias("typed")] if kind is not None else []
    counted = index.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *typed).filter(F.col("n") >= threshold)
    return (counted.filter("typed") if typed else counted).select("tag", "n")


def _prefixed_characters(tags):
    names = F.filter(tags, lambda t: t.startswith("character:"))
    return F.transform(names, lambda t: normal.space_form(normal.strip(F.get(F.split(t, ":"), F.lit(1)))))


def co_occurrence(df: DataFrame, tags: str = "tags", distinct: bool = False) -> DataFrame:
    """``(character, tag, cnt)``: how often each tag stands in captions of each ``character:`` tag.

    The pairs come from within one row, so there is no self-join; counts are summed map-side before the shuffle.
    """
    forms = F.transform(F.col(tags), lambda t: normal.space_form(t))
    names = _prefixed_characters(F.col(tags))
    if distinct:
        forms, names = F.array_distinct(forms), F.array_distinct(names)
    per_name = explode_rows(df.select(names.alias("names"), forms.alias("forms")), ["forms"], F.col("names"), "character")
    pairs = explode_rows(per_name, ["character"], F.col("forms"), "tag")
    return pairs.groupBy("character", "tag").agg(F.count(F.lit(1)).alias("cnt"))


Patterns = DataFrame | Sequence[str]
PATTERN_LIMIT = 10_000


def feature_patterns(patterns: Patterns) -> list[Regex]:
    """Patterns of feature tags, given as a list or as a table ``(pattern)``: a parameter of bounded size."""
    if isinstance(patterns, DataFrame):
        rows = collect_if_small(patterns.select("pattern").dropna().distinct(), PATTERN_LIMIT)
        if rows is None:
            raise ValueError(f"at most {PATTERN_LIMIT} patterns")
        patterns = sorted(r.pattern for r in rows)
    return [loose(p) for p in patterns]


def _is_feature(tag, patterns: Patterns):
    return tg.matches(normal.space_form(tag), feature_patterns(patterns))


def features_from_counts(
    counts: DataFrame,
    patterns: Patterns,
    freq_threshold: float = 0.3,
    count_threshold: int = 1,
    least_sample_size: int = 50,
) -> DataFrame:
    """Counts to ``(character, feature, cnt, freq)``.

    A character's own count is its total.  The totals are one more aggregate over the same counts, so the
    heavy exchange is reused and no window gathers a character's rows in one task.
    """
    totals = (
        counts.groupBy("character")
        .agg(F.max(F.when(F.col("tag") == F.col("character"), F.col("cnt"))).alias("total"))
        .filter(F.col("total") >= least_sample_size)
    )
    # The feature test mentions the count, so it stays above the aggregate and both branches share its exchange.
    enough = F.when(F.col("cnt") >= count_threshold, _is_feature(F.col("tag"), patterns))
    return (
        counts.join(totals, "character")
        .withColumn("freq", F.col("cnt") / F.col("total"))
        .filter((F.col("freq") >= freq_threshold) & enough)
        .select("character", F.col("tag").alias("feature"), "cnt", "freq")
    )


def features_from_freqs(
    freqs: DataFrame, patterns: Patterns, freq_threshold: float = 0.3
) -> DataFrame:
    """Frequencies ``(character, tag, freq)`` to a feature table."""
    kept = freqs.filter((F.col("freq") >= freq_threshold) & _is_feature(F.col("tag"), patterns))
    return kept.select("character", F.col("tag").alias("feature"), "freq")


def character_features(
    df: DataFrame,
    retype,
    patterns: Patterns,
    tags: str = "tags",
) -> DataFrame:
    """``(character, feature, cnt, freq)`` over captions with spaces and escapes.

    ``retype`` adds the ``typed`` column.  A null marker per character occurrence counts the captions in the same
    aggregate as the features.
    """
    compiled = feature_patterns(patterns)
    prepared = retype(df.drop("typed").withColumn(tags, tg.escaped(tg.spaced(F.col(tags)))))
    marker = F.array(F.lit(None).cast("string"))
    found = prepared.select(
        dv.characters(F.col("typed")).alias("names"), F.concat(marker, tg.keep(F.col(tags), compiled)).alias("found")
    )
    per_name = explode_rows(found, ["found"], F.col("names"), "character")
    pairs = per_name.select("character", F.explode_outer("found").alias("feature"))
    counts = pairs.groupBy("character", "feature").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("character").agg(F.max(F.when(F.col("feature").isNull(), F.col("cnt"))).alias("total"))
    return (
        counts.join(totals, "character")
        .filter(F.col("feature").isNotNull())
        .select("character", "feature", "cnt", (F.col("cnt") / F.col("total")).alias("freq"))
    )


def quality_report(df: DataFrame, listing: DataFrame | None = None, tags: str = "tags", key: str = "image_key") -> DataFrame:
    """``(kind, key)`` rows for missing captions, missing categories and files absent from a listing."""
    folder = paths.category(F.col("image_path"))
    known = df
    missing_file = F.lit(False)
    if listing is not None:
        files = listing.select("image_path").distinct().withColumn("__there", F.lit(True))
        known = df.join(files, "image_path", "left")
        missing_file = F.col("__there").isNull()
    kinds = F.array(
        F.when(F.col(tags).isNull(), "missing_caption"),
        F.when(folder.isNull() | (folder == ""), "missing_category"),
        F.when(missing_file, "missing_image_file"),
    )
    return explode_rows(known, [key], F.array_compact(kinds), "kind")


def quality_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def categories(df: DataFrame, path: str = "image_path") -> DataFrame:
    """Distinct categories, sorted."""
    return df.select(paths.category(F.col(path)).alias("category")).distinct().orderBy("category")


def summary(df: DataFrame, path: str = "image_path", shown: int = 5) -> DataFrame:
    """One row: number of records, number of categories, the first sorted categories and ``...`` if there are more.

    Records are counted per category first; only the first few category names are gathered.
    """
    per_category = df.groupBy(paths.category(F.col(path)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    totals = per_category.agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_categories"))
    first = (
        per_category.select("category")
        .orderBy("category")
        .limit(shown)
        .agg(F.sort_array(F.collect_list("category")).alias("first_categories"))
    )
    one = totals.unionByName(first, allowMissingColumns=True).agg(
        F.coalesce(F.max("n_records"), F.lit(0)).alias("n_records"),
        F.max("n_categories").alias("n_categories"),
        F.max("first_categories").alias("first_categories"),
    )
    more = F.when(F.col("n_categories") > shown, tg.lit_tags(["..."])).otherwise(tg.empty())
    return one.withColumn("first_categories", F.concat("first_categories", more))
