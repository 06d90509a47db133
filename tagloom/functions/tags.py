"""Ordered tag-list algebra on ``array<string>`` columns.

Order and duplicates are kept, so set functions (``array_union``, ``array_intersect``) are not used.
A match operand is a literal string (equality), a :class:`Regex` (anchored at the start), a list of
both, or an array Column (membership).  A null list stays null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import normal
from .binding import let
from .rules import Regex, WEIGHTED_TAG_PATTERN, java_replacement

SEP = ", "
Operand = str | Regex | Sequence | Column


def empty() -> Column:
    return F.array().cast("array<string>")


def or_empty(tags: Column) -> Column:
    """A null caption edits like one without tags."""
    return F.coalesce(tags, empty())


def lit_tags(tags: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def clean(tags: Column) -> Column:
    """Trim every tag and drop the empty ones."""
    return F.filter(F.transform(tags, lambda t: normal.strip(t)), lambda t: t != "")


def parse(caption: Column, sep: str = SEP, fix_typos: bool = True) -> Column:
    """Caption text to a tag list."""
    if fix_typos:
        caption = F.replace(caption, F.lit("，"), F.lit(","))
    return clean(F.split(caption, r"\Q" + sep + r"\E"))


def render(tags: Column, sep: str = SEP) -> Column:
    return F.array_join(tags, sep)


def matches(tag: Column, operand: Operand) -> Column:
    """Whether one tag matches any part of the operand."""
    if isinstance(operand, Column):
        return F.array_contains(operand, tag)
    parts = [operand] if isinstance(operand, (str, Regex)) else list(operand)
    literals = [p for p in parts if isinstance(p, str)]
    tests = [tag.isin(literals)] if literals else []
    tests += [tag.rlike(p.anchored) for p in parts if isinstance(p, Regex)]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def as_tags(operand: Sequence[str] | Column) -> Column:
    return operand if isinstance(operand, Column) else lit_tags(operand)


# -- list algebra ---------------------------------------------------------------------------


def unique(tags: Column) -> Column:
    """First occurrence of every tag, in order."""
    return F.array_distinct(tags)


def append_all(tags: Column, other: Sequence[str] | Column) -> Column:
    return F.concat(tags, as_tags(other))


def remove(tags: Column, operand: Operand) -> Column:
    if isinstance(operand, Column):
        return let(operand, lambda o: F.filter(tags, lambda t: ~F.array_contains(o, t)))
    return F.filter(tags, lambda t: ~matches(t, operand))


def keep(tags: Column, operand: Operand) -> Column:
    if isinstance(operand, Column):
        return let(operand, lambda o: F.filter(tags, lambda t: F.array_contains(o, t)))
    return F.filter(tags, lambda t: matches(t, operand))


def union(tags: Column, other: Sequence[str] | Column) -> Column:
    """``tags``, then those of ``other`` that are not in ``tags``."""
    return let(tags, lambda a: F.concat(a, F.filter(as_tags(other), lambda t: ~F.array_contains(a, t))))


def order_by_level(tags: Column, level) -> Column:
    """Stable order by an integer level per tag; ``level`` maps (tag, position) to a Column."""
    keyed = F.transform(
        tags, lambda t, i: F.struct(level(t, i).cast("int").alias("level"), i.alias("pos"), t.alias("tag"))
    )
    return F.transform(F.sort_array(keyed), lambda x: x["tag"])


def first_level(tag: Column, patterns: Sequence[str | Regex], default: int) -> Column:
    """Index of the first pattern that matches the tag (plain strings are patterns here too)."""
    chain = None
    for i, p in enumerate(patterns):
        hit = tag.rlike((p if isinstance(p, Regex) else Regex(p)).anchored)
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    return F.lit(default) if chain is None else chain.otherwise(default)


def prioritise(tags: Column, patterns: Sequence[str | Regex]) -> Column:
    """Move matches of each pattern, in pattern order, to the front; the rest keeps its order."""
    return order_by_level(tags, lambda t, i: first_level(t, patterns, len(patterns)))


def contains(tags: Column, operand: Operand) -> Column:
    """Whether any tag matches; a null list contains nothing."""
    return F.coalesce(F.exists(tags, lambda t: matches(t, operand)), F.lit(False))


def satisfies(tags: Column, operands: Sequence[str | Regex], condition: str = "any", relation: str = "include") -> Column:
    """``any`` or ``all`` of the operands included in (or excluded from) the list."""
    tests = [contains(tags, o) if relation == "include" else ~contains(tags, o) for o in operands]
    if not tests:
        return F.lit(condition == "all")
    return reduce((lambda a, b: a | b) if condition == "any" else (lambda a, b: a & b), tests)


# -- text edits inside tags ------------------------------------------------------------------


def _edit_first(tags: Column, changes, edit, count: int) -> Column:
    """Apply ``edit`` to the first ``count`` tags for which ``changes`` holds (all if negative)."""
    if count == 0:
        return clean(tags)
    edited = lambda t: F.when(changes(t), edit(t)).otherwise(t)
    if count < 0:
        return clean(F.transform(tags, edited))
    hits = F.filter(
        F.transform(tags, lambda t, i: F.when(changes(t), i)), lambda i: i.isNotNull()
    )
    last = F.coalesce(F.get(hits, F.lit(count - 1)), F.size(tags))
    return clean(F.transform(tags, lambda t, i: F.when(i <= last, edited(t)).otherwise(t)))


def replace_text(tags: Column, old: str, new: str, count: int = -1) -> Column:
    """Replace a substring inside tags, in at most ``count`` changed tags."""
    edit = lambda t: F.replace(t, F.lit(old), F.lit(new))
    return _edit_first(tags, lambda t: edit(t) != t, edit, count)


def replace_tag(tags: Column, old: str | Regex, new: str, count: int = -1) -> Column:
    """Replace whole tags equal to a literal, or substitute in tags a regex matches at the start."""
    if isinstance(old, Regex):
        edit = lambda t: F.regexp_replace(t, old.java, java_replacement(new))
    else:
        edit = lambda t: F.lit(new)
    return _edit_first(tags, lambda t: matches(t, old), edit, count)


def substitute(tags: Column, pattern: str | Regex, replacement: str, count: int = -1) -> Column:
    """Regex substitution anywhere in every tag, in at most ``count`` changed tags."""
    regex = pattern if isinstance(pattern, Regex) else Regex(pattern)
    edit = lambda t: F.regexp_replace(t, regex.java, java_replacement(replacement))
    return _edit_first(tags, lambda t: edit(t) != t, edit, count)


def underlined(tags: Column) -> Column:
    return replace_text(tags, " ", "_")


def spaced(tags: Column) -> Column:
    return replace_text(tags, "_", " ")


def lowered(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.lower(t))


def stripped(tags: Column, chars: str | None = None) -> Column:
    cut = (lambda t: normal.strip(t)) if chars is None else (lambda t: normal.strip(t, chars))
    return clean(F.transform(tags, cut))


def escaped(tags: Column) -> Column:
    return F.transform(tags, lambda t: normal.escape(t))


def unescaped(tags: Column) -> Column:
    return F.transform(tags, lambda t: normal.unescape(t))


def unweighted(tags: Column) -> Column:
    """``(name:1.2)`` or ``(name)`` to ``name``; escaped brackets are part of the name."""
    return F.transform(tags, lambda t: F.regexp_replace(t, WEIGHTED_TAG_PATTERN, "$1"))


# -- positions -------------------------------------------------------------------------------


def length(tags: Column) -> Column:
    return F.when(tags.isNotNull(), F.size(tags))


def pick(tags: Column, index: int) -> Column:
    """One tag by position; negative positions count from the end, out of range is null."""
    return F.get(tags, F.lit(index) if index >= 0 else F.size(tags) + F.lit(index))


def cut(tags: Column, start: int | None = None, stop: int | None = None) -> Column:
    """Positions ``start`` (included) to ``stop`` (excluded), negative ones from the end."""
    n = F.size(tags)

    def at(position: int | None, default: Column) -> Column:
        if position is None:
            return default
        absolute = F.lit(position) if position >= 0 else n + F.lit(position)
        return F.least(F.greatest(absolute, F.lit(0)), n)

    first, last = at(start, F.lit(0)), at(stop, n)
    return F.slice(tags, first + 1, F.greatest(last - first, F.lit(0)))


def reversed_tags(tags: Column) -> Column:
    return F.reverse(tags)


def equals(tags: Column, other: Sequence[str] | Column) -> Column:
    return tags == as_tags(other)


# -- templates and edits ---------------------------------------------------------------------

CATEGORY_MARKS = ("%dir%", "%dirname%", "%cat%", "%category%")
STEM_MARKS = ("%stem%", "%filename%")


def fill_template(tag: str, category: Column | None, stem: Column | None) -> Column:
    """Fill category and stem marks of one tag; any other ``%…%`` is refused."""
    rest = tag
    for mark in CATEGORY_MARKS + STEM_MARKS:
        rest = rest.replace(mark, "")
    if rest.count("%") >= 2:
        raise ValueError(f"invalid tag format: {tag!r}")
    out = F.lit(tag)
    for marks, value in ((CATEGORY_MARKS, category), (STEM_MARKS, stem)):
        for mark in marks:
            if mark in tag:
                if value is None:
                    raise ValueError(f"no value for {mark} in {tag!r}")
                out = F.replace(out, F.lit(mark), value)
    return out


def fill_templates(new: Sequence[str], category: Column | None = None, stem: Column | None = None) -> Column:
    return F.array(*[fill_template(t, category, stem) for t in new]).cast("array<string>")


def add(tags: Column, new: Sequence[str], append: bool = False, category: Column | None = None,
        stem: Column | None = None) -> Column:
    """Add tags in front (or at the end); a tag already there moves.  Null counts as empty."""
    base, filled = or_empty(tags), fill_templates(new, category, stem)
    if append:
        return union(remove(base, filled), filled)
    return union(filled, base)


def replace_any(tags: Column, old: str, new: str, whole: bool = False, regex: bool = False) -> Column:
    """The replace edit: a regex substitution, a whole-tag replacement, or a substring replacement."""
    if regex:
        return substitute(tags, old, new)
    return replace_tag(tags, old, new) if whole else replace_text(tags, old, new)
