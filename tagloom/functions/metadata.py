"""Metadata columns: post metadata, generation parameters, base-36 ids, codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from . import tags as tg
from .binding import let
from .rules import RATING_CODES, TAG_TYPE_CODES


def booru_tags(meta: Column) -> Column:
    """Tag list of a post: meta tags dropped, artists and characters prefixed, spaces for underscores.

    Source order is kept.
    """
    words = lambda name: F.split(F.coalesce(meta[name], F.lit("")), " ")

    def body(s: Column) -> Column:
        kept = F.filter(s["all"], lambda t: (t != "") & ~F.array_contains(s["meta"], t))
        named = F.transform(
            kept,
            lambda t: F.when(F.array_contains(s["artist"], t), F.concat(F.lit("artist: "), t))
            .when(F.array_contains(s["character"], t), F.concat(F.lit("character: "), t))
            .otherwise(t),
        )
        return F.transform(F.array_distinct(named), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))

    return F.when(
        meta.isNotNull(),
        let(
            F.struct(
                words("tag_string").alias("all"),
                words("tag_string_artist").alias("artist"),
                words("tag_string_character").alias("character"),
                words("tag_string_meta").alias("meta"),
            ),
            body,
        ),
    )


def gen_info_from_parameters(text: Column) -> Column:
    """``positive Negative prompt: … Steps: …, k: v, …`` to a map; a text without steps gives null."""
    negative_mark, steps_mark = r"\QNegative prompt: \E", r"\QSteps: \E"
    has_negative = F.contains(text, F.lit("Negative prompt: "))
    head = F.split(text, negative_mark, 2)
    tail = F.when(has_negative, F.get(head, F.lit(1))).otherwise(text)
    parts = F.split(tail, steps_mark, 2)
    positive = F.when(has_negative, F.get(head, F.lit(0))).otherwise(F.get(parts, F.lit(0)))
    negative = F.when(has_negative, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    pairs = F.transform(
        F.split(F.concat(F.lit("Steps: "), F.get(parts, F.lit(1))), r"\Q, \E"), lambda p: F.split(p, r"\Q: \E")
    )
    entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), F.get(p, F.lit(1)).alias("value")))
    fixed = F.array(
        F.struct(F.lit("Positive prompt").alias("key"), positive.alias("value")),
        F.struct(F.lit("Negative prompt").alias("key"), negative.alias("value")),
    )
    return F.when(F.size(parts) > 1, last_wins_map(F.concat(fixed, entries)))


def last_wins_map(entries: Column) -> Column:
    """``map_from_entries`` in which the last of several equal keys wins, whatever the session's policy."""

    def body(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e["key"])
        indexed = F.filter(
            F.transform(all_, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
            lambda e: F.array_position(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]) == 0,
        )
        return F.transform(indexed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    return F.map_from_entries(let(entries, body))


def gen_info_from_comment(metadata: Column) -> Column:
    """``Title`` + ``Comment`` metadata: the JSON comment's keys are capitalised and merged over the rest."""
    comment = F.from_json(metadata["Comment"], "map<string,string>")
    renamed = F.transform(
        F.map_entries(comment),
        lambda e: F.struct(
            F.when(F.lower(e["key"]) == "prompt", "Positive prompt")
            .when(F.lower(e["key"]) == "uc", "Negative prompt")
            .otherwise(F.concat(F.upper(F.substring(e["key"], 1, 1)), F.lower(F.substring(e["key"], 2, 1 << 30))))
            .alias("key"),
            e["value"].alias("value"),
        ),
    )
    rest = F.filter(F.map_entries(metadata), lambda e: e["key"] != "Comment")
    return last_wins_map(F.concat(rest, renamed))


def gen_info(metadata: Column) -> Column:
    """Generation parameters of either style from an image's metadata map; unknown metadata gives an empty map."""
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return (
        F.when(F.map_contains_key(metadata, "parameters"), gen_info_from_parameters(metadata["parameters"]))
        .when(F.map_contains_key(metadata, "Title"), gen_info_from_comment(metadata))
        .otherwise(none)
    )


def to_base36(number: Column) -> Column:
    digits = F.lower(F.conv(F.abs(number).cast("string"), 10, 36))
    return F.when(number < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def from_base36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("bigint")


def _label(code: Column, labels: Mapping[int, str]) -> Column:
    chain = None
    for value, label in labels.items():
        chain = F.when(code == value, label) if chain is None else chain.when(code == value, label)
    return chain


def rating_label(code: Column) -> Column:
    return _label(code, RATING_CODES)


def tag_type_label(code: Column) -> Column:
    return _label(code, TAG_TYPE_CODES)


def flag(value: Column) -> Column:
    return value.cast("boolean")
