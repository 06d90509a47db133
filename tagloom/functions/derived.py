"""Attributes derived from a tag list: types, artist, quality, characters, styles, copyrights.

A *typed* list is ``array<struct<tag, norm, kind, type>>``: the tag, its underscore form, the dictionary
kind that form belongs to (null if none) and the resulting type.  ``operators.dictionary`` builds it for
dictionaries of any size; :func:`typed` is the row-local form for dictionaries small enough to inline.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, functions as F

from . import normal, tags as tg
from .binding import let
from .rules import (
    ARTIST_BY_PATTERN,
    ARTIST_PREFIX_PATTERN,
    QUALITY_NUMBERS,
    QUALITY_PATTERN,
    SCORE_LADDER,
    STYLE_PREFIX_PATTERN,
    TYPE_PREFIXES,
    java_regex,
)

#: Dictionary kinds in the order in which they decide a tag's type.
KIND_ORDER = ("artist", "character", "style", "copyright", "quality")


def _u(pattern: str) -> str:
    return "(?U)" + java_regex(pattern)


def rule_type(tag: Column) -> Column:
    """The type a tag's own spelling decides, or null when a dictionary has to."""
    chain = None
    for prefix in TYPE_PREFIXES:
        hit = tag.startswith(prefix + ":")
        chain = F.when(hit, prefix) if chain is None else chain.when(hit, prefix)
    plain = ~F.contains(tag, F.lit(":"))
    return chain.when(plain & F.contains(tag, F.lit("quality")), "quality").when(
        plain & tag.rlike(r"(?U)\Aby \w"), "artist"
    )


def typed_entry(tag: Column, norm: Column, kind: Column) -> Column:
    return F.struct(
        tag.alias("tag"),
        norm.alias("norm"),
        kind.alias("kind"),
        F.coalesce(rule_type(tag), kind, F.lit("general")).alias("type"),
    )


def with_norm(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), normal.underscore_form(t).alias("norm")))


def kind_of(norm: Column, sets: Mapping[str, Collection[str]]) -> Column:
    """Dictionary kind of an underscore form; long literal lists become hash-set lookups."""
    chain = None
    for kind in KIND_ORDER:
        words = list(sets.get(kind) or ())
        if words:
            hit = norm.isin(words)
            chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return F.lit(None).cast("string") if chain is None else chain


def typed(tags: Column, sets: Mapping[str, Collection[str]]) -> Column:
    return F.transform(with_norm(tags), lambda x: typed_entry(x["tag"], x["norm"], kind_of(x["norm"], sets)))


def plain(typed_tags: Column) -> Column:
    return F.transform(typed_tags, lambda x: x["tag"])


# -- reading attributes ------------------------------------------------------------------------


def _first_group(text: Column, pattern: str) -> Column:
    """First group of the first match, or null; the patterns used here match no empty group."""
    return F.get(F.regexp_extract_all(text, F.lit(_u(pattern)), F.lit(1)), F.lit(0))


def artist(tags: Column) -> Column:
    """``artist: X`` first, else ``by X``; searched in the caption text."""
    return let(
        tg.render(tags),
        lambda text: F.coalesce(_first_group(text, ARTIST_PREFIX_PATTERN), _first_group(text, ARTIST_BY_PATTERN)),
    )


def quality(tags: Column) -> Column:
    """The word of the first ``X quality``."""
    return _first_group(tg.render(tags), QUALITY_PATTERN)


def _null_if_none(items: Column) -> Column:
    return let(items, lambda x: F.when(F.size(x) > 0, x))


def characters(typed_tags: Column) -> Column:
    hits = F.filter(typed_tags, lambda x: x["type"] == "character")
    return _null_if_none(F.transform(hits, lambda x: normal.strip_prefix(x["tag"])))


def styles(typed_tags: Column, style_tags: Collection[str]) -> Column:
    """Every ``style: X``, then tags spelled exactly as in the style dictionary."""
    return _null_if_none(let(plain(typed_tags), lambda tags: _styles(tags, style_tags)))


def _styles(tags: Column, style_tags: Collection[str]) -> Column:
    prefixed = F.regexp_extract_all(tg.render(tags), F.lit(_u(STYLE_PREFIX_PATTERN)), F.lit(1))
    return F.concat(prefixed, tg.keep(tags, list(style_tags)) if style_tags else tg.empty())


def copyrights(typed_tags: Column) -> Column:
    return plain(F.filter(typed_tags, lambda x: F.coalesce(x["kind"] == "copyright", F.lit(False))))


def metatags(typed_tags: Column, kind: str) -> Column:
    """Tags that a dictionary assigns to ``kind`` (prefixed ones included, as forms drop prefixes)."""
    return plain(F.filter(typed_tags, lambda x: F.coalesce(x["kind"] == kind, F.lit(False))))


# -- edits driven by types ----------------------------------------------------------------------


def prefix_metatags(typed_tags: Column) -> Column:
    """Prefix dictionary hits: all characters and styles, and only the last artist hit."""

    def body(s: Column) -> Column:
        return F.transform(
            s["typed"],
            lambda x, i: F.when(
                (x["kind"] == "artist") & (i == s["at"]) & ~x["tag"].startswith("artist:"),
                F.concat(F.lit("artist: "), x["tag"]),
            )
            .when(
                x["kind"].isin("character", "style") & ~x["tag"].startswith(F.concat(x["kind"], F.lit(":"))),
                F.concat(x["kind"], F.lit(": "), x["tag"]),
            )
            .otherwise(x["tag"]),
        )

    def bound(items: Column) -> Column:
        last_artist = F.get(F.reverse(metatags(items, "artist")), F.lit(0))
        at = F.array_position(plain(items), last_artist) - 1
        return let(F.struct(items.alias("typed"), at.cast("int").alias("at")), body)

    return let(typed_tags, bound)


def formalise(typed_tags: Column) -> Column:
    """``type: name`` for artists, characters and styles; a leading ``by`` of an artist is dropped."""

    def one(x: Column) -> Column:
        bare = lambda name: F.when(
            (x["type"] == "artist") & name.rlike(r"(?U)\Aby[\s_]\w"), normal.strip(F.substr(name, F.lit(4)), "_ ")
        ).otherwise(name)
        name = let(normal.strip(F.substring_index(x["tag"], ":", -1), "_ "), bare)
        return F.when(
            x["type"].isin("artist", "character", "style"), F.concat(x["type"], F.lit(": "), name)
        ).otherwise(x["tag"])

    return F.transform(typed_tags, one)


def deformalise(tags: Column) -> Column:
    return F.transform(tags, lambda t: normal.strip_prefix(t, by_artist=True))


def remove_type(typed_tags: Column, kind: str) -> Column:
    """Remove all tags of a type, by prefix or by dictionary."""
    return plain(
        F.filter(
            typed_tags,
            lambda x: ~(F.coalesce(x["kind"] == kind, F.lit(False)) | x["tag"].startswith(kind + ":")),
        )
    )


def with_artist(typed_tags: Column, new: Column | str) -> Column:
    """Rename the artist inside the first artist tag, or put ``artist: X`` in front; null changes nothing."""
    new = F.lit(new) if isinstance(new, str) else new

    def body(s: Column) -> Column:
        renamed = F.transform(
            s["typed"],
            lambda x, i: F.when(i == s["at"], F.replace(x["tag"], s["old"], s["new"])).otherwise(x["tag"]),
        )
        return (
            F.when(s["new"].isNull() | F.equal_null(s["new"], s["old"]), F.transform(s["typed"], lambda x: x["tag"]))
            .when(s["old"].isNotNull(), renamed)
            .otherwise(
                F.concat(F.array(F.concat(F.lit("artist: "), s["new"])), F.transform(s["typed"], lambda x: x["tag"]))
            )
        )

    def bound(items: Column) -> Column:
        at = F.array_position(F.transform(items, lambda x: x["type"]), F.lit("artist")) - 1
        return let(
            F.struct(
                items.alias("typed"), artist(plain(items)).alias("old"), new.alias("new"), at.cast("int").alias("at")
            ),
            body,
        )

    return let(typed_tags, bound)


def with_quality(tags: Column, new: Column | str | None) -> Column:
    """Put a quality word in place of every quality tag's word, or in front if there is none."""
    new = F.lit(new).cast("string") if new is None or isinstance(new, str) else new

    def body(s: Column) -> Column:
        swapped = tg.clean(
            F.transform(
                s["tags"],
                lambda t: F.regexp_replace(
                    t, F.lit(_u(QUALITY_PATTERN)), F.coalesce(F.concat(s["new"], F.lit("$2")), F.lit(""))
                ),
            )
        )
        return (
            F.when(F.equal_null(s["new"], s["old"]), s["tags"])
            .when(s["old"].isNotNull(), swapped)
            .otherwise(F.concat(F.array(F.concat(s["new"], F.lit(" quality"))), s["tags"]))
        )

    return let(
        tg.or_empty(tags),
        lambda base: let(F.struct(base.alias("tags"), new.alias("new"), quality(base).alias("old")), body),
    )


def score_to_quality(score: Column) -> Column:
    chain = F.when(score.isNull(), F.lit(None))
    for bound, word in SCORE_LADDER:
        chain = chain.when(score >= bound, word)
    return chain.otherwise("horrible")


def quality_from_score(tags: Column, score: Column, mode: str = "overwrite") -> Column:
    """Set the quality word from the score; ``ignore`` keeps a quality that is there; no score, no change."""
    keep = score.isNull()
    if mode == "ignore":
        keep = keep | quality(tg.or_empty(tags)).isNotNull()
    return F.when(keep, tags).otherwise(with_quality(tags, score_to_quality(score)))


def quality_number(tags: Column) -> Column:
    """Quality as a number; no caption or no quality counts as normal."""

    def number(word: Column) -> Column:
        chain = None
        for name, value in QUALITY_NUMBERS.items():
            chain = F.when(word == name, value) if chain is None else chain.when(word == name, value)
        return chain.otherwise(QUALITY_NUMBERS["normal"])

    return let(quality(tg.or_empty(tags)), number)


# -- formats -------------------------------------------------------------------------------------

#: Formats that need only the tags; ``analytical`` needs a typed list.
FORMATS = {
    "space": tg.spaced,
    "underline": tg.underlined,
    "escape": tg.escaped,
    "unescape": tg.unescaped,
    "standard": deformalise,
}


def apply_formats(tags: Column, formats: list[str], sets: Mapping[str, Collection[str]] | None = None) -> Column:
    """Apply named formats in list order."""
    for name in formats:
        tags = formalise(typed(tags, sets or {})) if name == "analytical" else FORMATS[name](tags)
    return tags


# -- index terms -----------------------------------------------------------------------------------


def _forms(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, tg.empty()), lambda t: normal.underscore_form(t))


def search_terms(tags: Column, style_tags: Collection[str] = ()) -> Column:
    """Distinct normalised tags a search looks at: the tags and the attributes derived from them.

    No dictionary is needed: a character found by dictionary has the same form as its tag.
    """

    def bound(items: Column) -> Column:
        named = F.filter(items, lambda t: t.startswith("character:"))
        return F.array_distinct(
            F.concat(
                _forms(items),
                _forms(F.transform(named, lambda t: normal.strip_prefix(t))),
                _forms(_styles(items, style_tags)),
                _forms(F.array_compact(F.array(artist(items)))),
            )
        )

    return let(tags, bound)


def index_terms(typed_tags: Column, style_tags: Collection[str] = ()) -> Column:
    """Index entries ``struct<tag, is_artist, is_character, is_style>`` of one record, one per distinct term."""

    def bound(items: Column) -> Column:
        return let(
            F.struct(
                search_terms(plain(items), style_tags).alias("terms"),
                _forms(F.array_compact(F.array(artist(plain(items))))).alias("artist"),
                _forms(characters(items)).alias("character"),
                _forms(styles(items, style_tags)).alias("style"),
            ),
            lambda s: F.transform(
                s["terms"],
                lambda t: F.struct(
                    t.alias("tag"),
                    *[F.array_contains(s[k], t).alias(f"is_{k}") for k in ("artist", "character", "style")],
                ),
            ),
        )

    return let(typed_tags, bound)
