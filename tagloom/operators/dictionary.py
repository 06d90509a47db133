"""Dictionary-driven operators: typing, priorities, de-overlap, feature removal, tag metadata.

Dictionaries are tables.  A dictionary with at most ``inline_limit`` entries is inlined into the row expression
(hash-set lookups, no shuffle).  A larger one is joined with the exploded tags: the entries of tags that very many rows
hold are broadcast (``heavy``), the others joined by shuffle, or by broadcast where Spark's own size check allows it; the
hits come back to their record with one shuffle on the key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import derived as dv, normal, tags as tg
from ..functions.binding import let
from ..functions.rules import LOWEST_PRIORITY, Regex, loose
from ..runtime import collect_if_small, explode_rows, gather, materialise
from .heavy import join_heavy

INLINE_LIMIT = 5000
INLINE_PAIRS = 200


def inline_kinds(tag_dict: DataFrame, limit: int = INLINE_LIMIT) -> dict[str, list[str]] | None:
    """``(kind, tag)`` rows as lists per kind if the dictionary is small, else None."""
    rows = collect_if_small(tag_dict.select("kind", "tag").dropna().distinct(), limit)
    if rows is None:
        return None
    sets: dict[str, list[str]] = defaultdict(list)
    for row in sorted(rows):
        sets[row.kind].append(row.tag)
    return dict(sets)


def _hits_by_position(
    df: DataFrame, key: str, norms: Column, table: DataFrame, table_key: str, value: str
) -> DataFrame:
    """``(key, hits map<pos, value>)`` for the tags whose norm is in the table.

    The exploded tags are written once: heavy norms are looked for in them and each of them is read again by the join.
    """
    exploded = materialise(explode_rows(df, [key], norms, "__pos", "__norm", position=True), "tag-norms")
    lookup = table.select(F.col(table_key).alias("__norm"), F.col(value).alias("__value"))
    hits = join_heavy(exploded, lookup, "__norm").select(key, "__pos", "__value")
    return gather(hits, key, F.map_from_entries(F.collect_list(F.struct("__pos", "__value"))).alias("__hits"))


def with_typed_tags(
    df: DataFrame,
    tag_dict: DataFrame,
    tags: str = "tags",
    key: str = "image_key",
    out: str = "typed",
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Add the typed list of every record (see ``functions.derived``)."""
    sets = inline_kinds(tag_dict, inline_limit)
    if sets is not None:
        return df.withColumn(out, dv.typed(F.col(tags), sets))
    rank = F.lit(None).cast("int")
    for i, kind in reversed(list(enumerate(dv.KIND_ORDER))):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    best = (
        tag_dict.withColumn("__rank", rank)
        .filter(F.col("__rank").isNotNull() & F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(F.min_by("kind", "__rank").alias("kind"))
    )
    hits = _hits_by_position(
        df, key, F.transform(F.col(tags), lambda t: normal.underscore_form(t)), best, "tag", "kind"
    )
    entry = lambda x, i: dv.typed_entry(x["tag"], x["norm"], F.try_element_at(F.col("__hits"), i))
    return df.join(hits, key, "left").withColumn(out, F.transform(dv.with_norm(F.col(tags)), entry)).drop("__hits")


def tag_types(df: DataFrame, typed: str = "typed", key: str = "image_key") -> DataFrame:
    """One row per tag of a record: ``(key, pos, tag, type)``."""
    return explode_rows(df, [key], F.col(typed), "pos", "x", position=True).select(
        key, "pos", F.col("x.tag").alias("tag"), F.col("x.type").alias("type")
    )


def lookup_tag_table(df: DataFrame, table: DataFrame, tag: str = "tag", default: str | None = None) -> DataFrame:
    """Add ``value`` of each tag from ``table(tag, value)``, found under its table form.

    Spellings with the same table form are one entry; the smallest value of them counts.
    """
    keyed = table.select(normal.table_form(F.col("tag")).alias("__norm"), "value").groupBy("__norm").agg(F.min("value").alias("value"))
    normed = df.withColumn("__norm", normal.table_form(F.col(tag)))
    return join_heavy(normed, keyed, "__norm", "left").drop("__norm").withColumn("value", F.coalesce("value", F.lit(default)))


# -- priorities ------------------------------------------------------------------------------------

#: Rows ``(level, category, pattern)`` or a table of them; a category matches if one of its patterns does.
Ladder = DataFrame | Sequence[tuple[int, str, str]]
LADDER_LIMIT = 10_000


def ladder_levels(ladder: Ladder) -> list[tuple[int, str, list[Regex]]]:
    """Levels in order with their compiled patterns.  A ladder is a parameter: a table of too many rows is refused."""
    if isinstance(ladder, DataFrame):
        rows = collect_if_small(ladder.select("level", "category", "pattern").dropna().distinct(), LADDER_LIMIT)
        if rows is None:
            raise ValueError(f"a ladder has at most {LADDER_LIMIT} rows")
        ladder = [tuple(r) for r in rows]
    levels: dict[tuple[int, str], list[Regex]] = defaultdict(list)
    for level, category, pattern in sorted(ladder):
        if pattern.strip():
            levels[level, category].append(loose(pattern))
    return [(level, category, patterns) for (level, category), patterns in levels.items()]


def ladder_priority(ladder: Ladder) -> Callable[[Column], Column]:
    """Priority of a tag: the first level with a matching pattern."""
    levels = ladder_levels(ladder)

    def priority(tag: Column) -> Column:
        hits = [F.when(tg.matches(tag, patterns), level) for level, _, patterns in levels]
        return F.coalesce(*hits, F.lit(LOWEST_PRIORITY))

    return priority


def _category_rules(tag: Column, ladder: Ladder, aesthetic: Sequence[str]) -> Column:
    index = {category: level for level, category, _ in ladder_levels(ladder)}
    found = {
        "artist": tag.startswith("artist:"),
        "character": tag.startswith("character:"),
        "style": tag.startswith("style:"),
        "quality": F.contains(tag, F.lit("quality")),
    }
    if aesthetic:
        found["aesthetic"] = tag.isin(list(aesthetic))
    return F.coalesce(*[F.when(hit, index[name]) for name, hit in found.items() if name in index], F.lit(None).cast("int"))


def with_table_priorities(
    df: DataFrame,
    priority_table: DataFrame,
    ladder: Ladder,
    aesthetic: Sequence[str] = (),
    tags: str = "tags",
    key: str = "image_key",
    out: str = "priorities",
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Add the priority of every tag: prefix and quality rules first, then ``priority_table(tag, priority)``.

    A tag that the table lists several times has the smallest of its priorities; null entries do not count.
    """
    priority_table = priority_table.select("tag", "priority").dropna().groupBy("tag").agg(F.min("priority").alias("priority"))
    rows = collect_if_small(priority_table, inline_limit)
    if rows is not None:
        by_level: dict[int, list[str]] = defaultdict(list)
        for row in sorted(rows):
            by_level[row.priority].append(row.tag)

        def level(pair: Column) -> Column:
            found = None
            for value, words in by_level.items():
                hit = pair["norm"].isin(words)
                found = F.when(hit, value) if found is None else found.when(hit, value)
            return F.coalesce(
                _category_rules(pair["tag"], ladder, aesthetic),
                F.lit(None).cast("int") if found is None else found,
                F.lit(LOWEST_PRIORITY),
            )

        pairs = F.transform(
            F.col(tags), lambda t: F.struct(t.alias("tag"), normal.priority_form(t).alias("norm"))
        )
        return df.withColumn(out, F.transform(pairs, level))
    norms = F.transform(F.col(tags), lambda t: normal.priority_form(t))
    hits = _hits_by_position(df, key, norms, priority_table, "tag", "priority")
    joined = df.join(hits, key, "left")
    level = lambda t, i: F.coalesce(
        _category_rules(t, ladder, aesthetic), F.try_element_at(F.col("__hits"), i), F.lit(LOWEST_PRIORITY)
    )
    return joined.withColumn(out, F.transform(F.col(tags), level)).drop("__hits")


def sort_by_priority(tags: Column, priorities: Column | Callable[[Column], Column], reverse: bool = False) -> Column:
    """Stable sort of the tags by priority; ``reverse`` keeps ties in caption order."""
    sign = -1 if reverse else 1
    if callable(priorities) and not isinstance(priorities, Column):
        return tg.order_by_level(tags, lambda t, i: priorities(t) * sign)
    return let(
        F.struct(tags.alias("t"), priorities.alias("p")),
        lambda s: tg.order_by_level(s["t"], lambda t, i: F.get(s["p"], i) * sign),
    )


# -- de-overlap --------------------------------------------------------------------------------------


def _drop_overlapped(
    tags: Column, children_of: Callable[[Column], Column], covering: Callable[[Column], Column] | None = None
) -> Column:
    """Walk distinct forms in caption order; a form not yet suppressed suppresses its children."""
    forms = F.array_distinct(F.transform(tags, lambda t: normal.underscore_form(t)))

    if covering is not None:  # only these suppress anything, and a caption holds few of them
        forms = F.filter(forms, covering)

    def step(gone: Column, form: Column) -> Column:
        more = F.coalesce(children_of(form), tg.empty())
        return F.when(F.array_contains(gone, form), gone).otherwise(F.concat(gone, more))

    return let(
        F.aggregate(forms, tg.empty(), step),
        lambda gone: F.filter(tags, lambda t: ~F.array_contains(gone, normal.underscore_form(t))),
    )


def deoverlap(
    df: DataFrame,
    overlap: DataFrame,
    tags: str = "tags",
    key: str = "image_key",
    inline_limit: int = INLINE_PAIRS,
) -> DataFrame:
    """Drop tags that a more specific tag of the same caption covers; ``overlap(query, parents, children)``.

    A query listed several times covers the children of all its rows; null queries and children do not count.
    """
    pairs = explode_rows(overlap.filter(F.col("query").isNotNull()), ["query"], F.col("children"), "__child")
    table = pairs.groupBy("query").agg(F.sort_array(F.collect_set("__child")).alias("children"))
    rows = collect_if_small(table, inline_limit)
    if rows is not None:
        def children_of(form: Column) -> Column:
            chain = None
            for row in rows:
                chain_hit = form == row.query
                value = tg.lit_tags(row.children)
                chain = F.when(chain_hit, value) if chain is None else chain.when(chain_hit, value)
            return tg.empty() if chain is None else chain

        names = [row.query for row in rows]
        return df.withColumn(tags, _drop_overlapped(F.col(tags), children_of, lambda form: form.isin(names)))
    distinct_forms = F.array_distinct(F.transform(F.col(tags), lambda t: normal.underscore_form(t)))
    forms = materialise(explode_rows(df, [key], distinct_forms, "query"), "tag-forms")  # read by the sketch and by the join
    hits = gather(
        join_heavy(forms, table, "query"),
        key,
        F.map_from_entries(F.collect_list(F.struct("query", "children"))).alias("__children"),
    )
    return (
        df.join(hits, key, "left")
        .withColumn(
            tags,
            _drop_overlapped(
                F.col(tags),
                lambda form: F.try_element_at(F.col("__children"), form),
                lambda form: F.coalesce(F.map_contains_key(F.col("__children"), form), F.lit(False)),
            ),
        )
        .drop("__children")
    )


# -- features ------------------------------------------------------------------------------------------


def defeature(
    df: DataFrame,
    features: DataFrame,
    characters: str = "characters",
    tags: str = "tags",
    inline_limit: int = 500,
) -> DataFrame:
    """Drop from each record the features of all its characters; ``features(character, feature)``.

    Every record stays, also those that share a key or have none.  Up to ``inline_limit`` features are a map in the row
    expression.  More of them are joined: the records are written once with a number of their own, only that number and
    the characters are exploded and shuffled, and what is found joins the written records again.
    """
    pairs = features.select(
        normal.space_form(F.col("character")).alias("__character"), normal.space_form(F.col("feature")).alias("__feature")
    ).filter("__character is not null and __feature is not null")
    names = F.array_distinct(F.transform(F.col(characters), lambda c: normal.space_form(c)))

    def without(found: Column) -> Column:
        kept = lambda feats: F.filter(F.col(tags), lambda t: ~F.coalesce(F.array_contains(feats, normal.space_form(t)), F.lit(False)))
        return F.when(F.coalesce(F.size(found), F.lit(0)) < 1, F.col(tags)).otherwise(let(found, kept))

    small = collect_if_small(pairs.distinct(), inline_limit)
    if small is not None:
        of: dict[str, list[str]] = {}
        for row in sorted(small):
            of.setdefault(row["__character"], []).append(row["__feature"])
        if not of:
            return df
        table = F.create_map(*[x for name, feats in of.items() for x in (F.lit(name), tg.lit_tags(feats))])
        found = F.flatten(F.transform(names, lambda c: F.coalesce(F.try_element_at(table, c), tg.empty())))
        return df.withColumn("__found", found).withColumn(tags, without(F.col("__found"))).select(*df.columns)
    grouped = pairs.groupBy("__character").agg(F.collect_set("__feature").alias("__features"))
    written = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "records")
    named = join_heavy(explode_rows(written, ["__row"], names, "__character"), grouped, "__character")
    per_row = gather(named, "__row", F.flatten(F.collect_list("__features")).alias("__features"))
    return written.join(per_row, "__row", "left").withColumn(tags, without(F.col("__features"))).select(*df.columns)


# -- composed edits ---------------------------------------------------------------------------------------


def optimise(
    df: DataFrame,
    tag_dict: DataFrame,
    overlap: DataFrame,
    ladder: Ladder,
    unwanted: Sequence[str | Regex] = (),
    tags: str = "tags",
    key: str = "image_key",
) -> DataFrame:
    """Formalise, de-duplicate, remove unwanted tags, order by the ladder, de-overlap."""
    typed = with_typed_tags(df, tag_dict, tags=tags, key=key, out="__typed")
    wanted = tg.remove(tg.unique(dv.formalise(F.col("__typed"))), list(unwanted))
    edited = typed.withColumn(tags, sort_by_priority(wanted, ladder_priority(ladder))).drop("__typed")
    return deoverlap(edited, overlap, tags=tags, key=key)
