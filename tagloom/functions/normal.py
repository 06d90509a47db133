"""Normal forms of a single tag, bracket escaping and prefix handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import ESCAPED_BRACKET_PATTERN, STRIPPED_PREFIXES, UNESCAPED_BRACKET_PATTERN, WHITESPACE


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def escape(text: Column) -> Column:
    """Put a backslash before every bracket that has none."""
    return F.regexp_replace(text, UNESCAPED_BRACKET_PATTERN, r"\\$1")


def unescape(text: Column) -> Column:
    """Drop the backslash before a bracket."""
    return F.regexp_replace(text, ESCAPED_BRACKET_PATTERN, "$1")


def strip_prefix(tag: Column, by_artist: bool = False) -> Column:
    """Drop ``artist:``, ``character:`` or ``style:``; the artist optionally becomes ``by X``.

    One substitution that mentions the tag once, so that the expression it is applied to runs once.
    """
    prefixed = lambda names: r"(?s)\A(?:" + "|".join(names) + r"):[_ ]*(.*?)[_ ]*\z"
    if by_artist:
        tag = F.regexp_replace(tag, prefixed(["artist"]), "by $1")
        return F.regexp_replace(tag, prefixed([p for p in STRIPPED_PREFIXES if p != "artist"]), "$1")
    return F.regexp_replace(tag, prefixed(STRIPPED_PREFIXES), "$1")


def underscore_form(tag: Column) -> Column:
    """Lower case, underscores, no escapes, no prefix: the form dictionaries and the index are keyed by."""
    text = F.replace(strip(F.replace(F.lower(tag), F.lit(" "), F.lit("_")), "_"), F.lit(":_"), F.lit(":"))
    return strip_prefix(unescape(text))


def space_form(tag: Column, by_artist: bool = False) -> Column:
    """Lower case, spaces, escaped brackets, no prefix: the form statistic tables are keyed by."""
    text = F.replace(strip(F.replace(F.lower(tag), F.lit("_"), F.lit(" ")), " "), F.lit(": "), F.lit(":"))
    return strip_prefix(escape(text), by_artist=by_artist)


def priority_form(tag: Column) -> Column:
    """Trimmed, lower case, no backslashes, underscores: the key of the priority table."""
    return F.replace(F.replace(F.lower(strip(tag)), F.lit("\\")), F.lit(" "), F.lit("_"))


def table_form(tag: Column) -> Column:
    """The key of the tag metadata table: as :func:`priority_form`, underscores stripped at the ends."""
    return strip(F.replace(F.replace(F.lower(tag), F.lit("\\")), F.lit(" "), F.lit("_")), "_")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7f]", "")
