"""Column functions for text (C2-C5, F1, F2). All JVM-side expressions.

Python's ``str.split()``/``strip()`` and ``\\s`` are Unicode-aware; Java's
regexes are not unless ``(?U)`` is set, so every whitespace class carries it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)\\s+"


def is_blank(text: Column) -> Column:
    """null, empty or whitespace-only."""
    return text.isNull() | ~text.rlike("(?U)\\S")


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (Python ``str.strip``)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens, punctuation kept."""
    return F.array_remove(F.split(F.lower(text), WS), "")


def sentences(text: Column) -> Column:
    """Split after ``.!?`` followed by whitespace, or at any newline."""
    return F.split(text, "(?U)(?<=[.!?])\\s+|\\n")


def collapse_lower(text: Column) -> Column:
    """C4: lower case with whitespace runs collapsed to one space (dedup key)."""
    return F.regexp_replace(F.lower(text), WS, " ")


def first_upper(text: Column) -> Column:
    """C4: first character upper-cased, the rest unchanged (not ``initcap``)."""
    return F.concat(F.upper(text.substr(F.lit(1), F.lit(1))), text.substr(F.lit(2), F.length(text)))


def normalise_name(name: Column) -> Column:
    """Lower case with ``_`` and ``-`` read as spaces."""
    return F.translate(F.lower(name), "_-", "  ")


def length_between(text: Column, lo: int, hi: int) -> Column:
    """character length within [lo, hi]."""
    return F.length(text).between(lo, hi)
