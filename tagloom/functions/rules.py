"""Fixed values and the small driver-side helper that turns Python regexes into Java ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

# ---- Fixed values: words, prefixes, codes and patterns that results depend on. ----
QUALITY_WORDS = ("amazing", "best", "high", "normal", "low", "worst", "horrible")
QUALITY_NUMBERS = {"horrible": 0.0, "worst": 2.0, "low": 3.5, "normal": 5.0, "high": 6.5, "best": 8.0, "amazing": 10.0}
SCORE_LADDER = ((9.0, "amazing"), (7.5, "best"), (6.0, "high"), (4.0, "normal"), (2.5, "low"), (1.0, "worst"))
SAFE_LEVELS = {"g": 0, "s": 1, "q": 2, "e": 3}
RATING_CODES = {0: "g", 1: "s", 2: "q", 3: "e"}
TAG_TYPE_CODES = {0: "general", 1: "artist", 2: "character", 3: "copyright", 4: "meta"}
TYPE_PREFIXES = ("artist", "character", "style", "quality", "copyright")
STRIPPED_PREFIXES = ("artist", "character", "style")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".jfif", ".webp")
BRACKETS = "()[]{}"
LOWEST_PRIORITY = 999
ARTIST_PREFIX_PATTERN = r"artist:[\s_]*([^,]+)"
ARTIST_BY_PATTERN = r"(?:^|,\s)by[\s_](\w[\w\-.\s()\\]*)"
STYLE_PREFIX_PATTERN = r"style:[\s_]*([^,]+)"
QUALITY_PATTERN = r"\b(" + "|".join(QUALITY_WORDS) + r")([\s_]quality)\b"
UNESCAPED_BRACKET_PATTERN = r"(?<!\\)([()\[\]{}])"
ESCAPED_BRACKET_PATTERN = r"\\([()\[\]{}])"
WEIGHTED_TAG_PATTERN = r"^\((.+?)(?::[\d.]+)?(?<!\\)\)$"

#: All characters Python's ``str.strip`` removes, from the rule itself.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

@dataclass(frozen=True)
class Regex:
    """A regular expression in Python syntax; matching is anchored at the start of the tag."""

    pattern: str

    @property
    def java(self) -> str:
        r"""The pattern for Spark: Unicode classes as in Python, named groups and ``\Z`` translated."""
        return "(?U)" + java_regex(self.pattern)

    @property
    def anchored(self) -> str:
        return r"(?U)\A(?:" + java_regex(self.pattern) + ")"


def loose(pattern: str) -> Regex:
    """A pattern of tags as people write it: a blank also stands for an underscore."""
    return Regex(r"[\s_]".join(pattern.split(" ")))


def java_regex(pattern: str) -> str:
    """Python regex syntax to Java regex syntax (validated by Python first)."""
    re.compile(pattern)
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return pattern.replace(r"\Z", r"\z")


def java_replacement(replacement: str) -> str:
    r"""Python replacement text (``\1``, ``\g<name>``) to Java's (``$1``, ``${name}``)."""
    out, i = [], 0
    while i < len(replacement):
        group = re.compile(r"\\g<(\w+)>|\\(\d{1,2})").match(replacement, i)
        if group:
            ref = group.group(1) or group.group(2)
            out.append(f"${ref}" if ref.isdigit() else "${" + ref + "}")
            i = group.end()
        else:
            char = replacement[i]
            out.append("\\" + char if char in "$\\" else char)
            i += 1
    return "".join(out)
