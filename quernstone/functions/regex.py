"""Regular expressions that mean in Java what they mean elsewhere.

Java folds only ASCII case under (?i) and reads \\s, \\w and \\b as ASCII; the builders here add the flags that make
both work on any script.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Small letters that Java's folding, through capitals, takes for others; the dot that a small İ keeps goes.
FOLDED_FROM, FOLDED_TO = "ſıᲀᲁᲂᲃᲄᲅᲆ\u0307", "siвдосттъ"


def folded(pattern: str) -> str:
    """The pattern, blind to case in any script."""
    return "(?iu)" + pattern.removeprefix("(?i)")


def unicode_classes(pattern: str) -> str:
    """The pattern with \\s, \\w, \\d and \\b of any script; no-break spaces count as white space."""
    return "(?U)" + pattern


def program(text: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """Applies (pattern, replacement) pairs one after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def any_contained(text: Column, needles: Iterable[str]) -> Column:
    """Whether any of some plain strings occurs; false for null."""
    found = reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles), F.lit(False))
    return F.coalesce(found, F.lit(False))


def anchor(pattern: str) -> str:
    """Lower-case letters and blanks that every match of the pattern begins with."""
    plain = re.match("[a-zа-яё ]*", pattern)[0]
    return plain[:-1] if pattern[len(plain) : len(plain) + 1] in ("?", "*", "{") else plain


def any_matched(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found; false for null. A pattern with an anchor of some length is tried only on texts that
    hold the anchor, which one folding of case tells for all patterns."""

    def found(low: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            there, start = F.rlike(text, F.lit(folded(p))), anchor(p)
            out = out | (F.contains(low, F.lit(start)) & there if len(start) > 2 and "|" not in re.sub(r"\([^()]*\)", "", p) else there)
        return out

    return F.coalesce(bound(F.translate(F.lower(text), FOLDED_FROM, FOLDED_TO), found), F.lit(False))


def split_before(text: Column, mark: str) -> Column:
    """Pieces of a text, cut before every line that starts with the pattern; without look-around, so SQL has the same."""
    cut = F.regexp_replace(text, F.lit(f"(^|\\n)({mark})"), F.lit("$1\x1f$2"))
    return F.filter(F.transform(F.split(cut, "\x1f"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
