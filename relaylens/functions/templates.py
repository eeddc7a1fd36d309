"""Mapping rules: telling patterns from plain names, and replacement templates in Java's syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a rule source with any of these characters is a regular expression.
PATTERN_CHARACTERS = r"[.*+?{}()\[\]^$]"

_DOLLAR, _OPEN, _CLOSE = "\u0000", "\u0001", "\u0002"


def is_pattern(source: Column) -> Column:
    return source.rlike(PATTERN_CHARACTERS)


def java_replacement(template: Column) -> Column:
    """A rule's target template as a Java replacement string.

    Rules write ``$1``, ``${1}``, ``$name``, ``${name}`` and ``$$`` for a dollar sign; a name is as long as
    letters, digits and underscores go on, so ``$1x`` asks for a group called ``1x``, which is empty. A blank
    template keeps the topic name.
    """
    text = F.replace(template, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("$$"), F.lit(_DOLLAR))
    text = F.regexp_replace(text, r"\$\{([A-Za-z0-9_]+)\}|\$([A-Za-z0-9_]+)", f"{_OPEN}$1$2{_CLOSE}")
    text = F.replace(text, F.lit("$"), F.lit(_DOLLAR))
    # "$1" before a literal digit: the digit is escaped, as Java would read a longer group number.
    text = F.regexp_replace(text, f"{_OPEN}([0-9]+){_CLOSE}(?=[0-9])", r"\$$1\\")
    text = F.regexp_replace(text, f"{_OPEN}([0-9]+){_CLOSE}", r"\$$1")
    text = F.regexp_replace(text, f"{_OPEN}[0-9][A-Za-z0-9_]*{_CLOSE}", "")
    text = F.regexp_replace(text, f"{_OPEN}([A-Za-z0-9_]+){_CLOSE}", r"\$\{$1\}")
    text = F.replace(text, F.lit(_DOLLAR), F.lit("\\$"))
    return F.when(F.coalesce(template, F.lit("")) == "", F.lit("$0")).otherwise(text)


def java_pattern(source: Column) -> Column:
    """A rule's pattern with named groups in Java's spelling."""
    return F.replace(source, F.lit("(?P<"), F.lit("(?<"))


def java_replaced_pattern(pattern: Column) -> Column:
    """The pattern for replacing all its matches: an empty match right behind another match does not count."""
    return F.concat(F.lit("(?>"), pattern, F.lit(r")(?:(?!\G)|(?<![\s\S]))"))
