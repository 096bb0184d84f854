"""Column functions for claims: qualification (F3), direction (C8), change
parsing (C9) and time windows (C10). Pure expressions; no UDF.

Direction and multiplier words are substring tests (so "up" fires inside
"supply"), as in the reference. ``(?U)`` keeps ``\\b``, ``\\d`` and ``\\s``
Unicode-aware like Python's regexes.
"""

from __future__ import annotations

import unicodedata

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def _any_substring(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


INC_RE = _any_substring(V.INCREASE_WORDS)
DEC_RE = _any_substring(V.DECREASE_WORDS)
DIR_RE = _any_substring(V.DIRECTION_WORDS)
MULT_RE = _any_substring(V.MULTIPLIER_WORDS)
# The shapes of numbers that make a sentence a claim.
PCT_RE = r"(?U)\d+(?:\.\d+)?\s*%"
DOLLAR_RE = r"(?iU)\$\s*\d+(?:\.\d+)?\s*(?:m|k|b|million|billion)?"
FROM_TO_RE = r"(?iU)\bfrom\s+[\$\d][\d,\.]*\s+to\s+[\$\d][\d,\.]*"
DIR_NUM_RE = (r"(?iU)\b(?:" + "|".join(V.DIRECTION_VERBS_WITH_NUMBER)
              + r")\s+(?:by\s+)?\d+(?:\.\d+)?(?!\s*%)")


# A word list is tested as one regex alternation: compact generated code
# (long OR chains of ``contains`` produce methods too large for the JIT).


def direction(claim_lower: Column) -> Column:
    """C8: 'increase' if any increase word occurs, else 'decrease' if any
    decrease word occurs, else null."""
    return (F.when(claim_lower.rlike(INC_RE), F.lit("increase"))
            .when(claim_lower.rlike(DEC_RE), F.lit("decrease")))


def qualifies(sentence: Column) -> Column:
    """(percent and direction) or multiplier or (dollar and direction) or
    from-X-to-Y or direction verb + number.

    The verbs of the last test are direction words, so the three tests that
    need a direction word share one check; those three need a digit, and the
    percent and dollar regexes only run when the sentence holds '%' or '$'.
    """
    low = F.lower(sentence)
    has_digit = sentence.rlike(r"(?U)\d")  # percent, dollar and verb+number all need one
    return ((has_digit & low.rlike(DIR_RE)
             & ((sentence.contains("%") & sentence.rlike(PCT_RE))
                | (sentence.contains("$") & sentence.rlike(DOLLAR_RE))
                | sentence.rlike(DIR_NUM_RE)))
            | low.rlike(MULT_RE)
            | ((has_digit | sentence.contains("$")) & sentence.rlike(FROM_TO_RE)))


#: Decimal digits of all scripts, and the ASCII digit that each stands for.
_DIGITS = [chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
_ASCII_OF = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits; only texts that hold one pay for it."""
    return F.when(text.rlike(r"(?U)[^\P{Nd}0-9]"), F.translate(text, "".join(_DIGITS), _ASCII_OF)).otherwise(text)


def change(claim: Column) -> Column:
    """struct(pct double, direction string, tolerance double, mode string).

    The first ``N%`` wins with tolerance 5; otherwise the multiplier rules in
    order; otherwise pct null with tolerance 5.
    """
    low = ascii_digits(F.lower(claim))
    pct_re = r"(?U)(\d+(?:\.\d+)?)\s*%"
    out = F.when(claim.contains("%") & low.rlike(pct_re), F.struct(
        F.regexp_extract(low, pct_re, 1).try_cast("double").alias("pct"),
        direction(low).alias("direction"),
        F.lit(V.PERCENT_TOLERANCE).alias("tolerance"),
        F.lit(None).cast("string").alias("mode")))
    nothing = F.struct(
        F.lit(None).cast("double").alias("pct"), F.lit(None).cast("string").alias("direction"),
        F.lit(V.PERCENT_TOLERANCE).alias("tolerance"), F.lit(None).cast("string").alias("mode"))
    # every multiplier rule needs a multiplier word: one check skips all seven
    out = out.when(~low.rlike(MULT_RE), nothing)
    for words, pct, dirn, tol, mode in V.MULTIPLIER_RULES:
        pat = r"(?U)\b" + r"\s+".join(words.split()) + r"\b"
        out = out.when(low.rlike(pat), F.struct(
            F.lit(pct).alias("pct"), F.lit(dirn).alias("direction"),
            F.lit(tol).alias("tolerance"), F.lit(mode).cast("string").alias("mode")))
    return out.otherwise(nothing)


QUARTER_RE = r"(?iU)\bQ([1-4])\b"
HALF_RE = r"(?iU)\bH([12])\b"
YEAR_RE = r"(?U)\b(FY)?(20\d{2}|19\d{2})\b"


def time_window(claim: Column) -> Column:
    """struct(type, value) for the first quarter, else half, else year
    reference; null when there is none, or when the claim says "from" and has
    two or more references."""
    none = F.array().cast("array<string>")
    claim = ascii_digits(claim)

    def guarded(cond, pattern, group):
        return F.when(cond, F.regexp_extract_all(claim, F.lit(pattern), group)).otherwise(none)

    q = guarded(claim.rlike("(?i)q[1-4]"), QUARTER_RE, 1)
    h = guarded(claim.rlike("(?i)h[12]"), HALF_RE, 1)
    y = guarded(claim.contains("19") | claim.contains("20"), YEAR_RE, 2)
    n = F.size(q) + F.size(h) + F.size(y)
    has_from = claim.rlike(r"(?iU)\bfrom\b")

    def win(kind: str, arr: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.get(arr, 0).try_cast("int").alias("value"))

    return (F.when(has_from & (n >= 2), F.lit(None))
            .when(F.size(q) > 0, win("quarter", q))
            .when(F.size(h) > 0, win("half", h))
            .when(F.size(y) > 0, win("year", y)))


def window_token(window: Column) -> Column:
    """The lower-case text a date value must contain for the window:
    q{n}, h{n} or the year."""
    return (F.when(window["type"] == "quarter", F.concat(F.lit("q"), window["value"].cast("string")))
            .when(window["type"] == "half", F.concat(F.lit("h"), window["value"].cast("string")))
            .when(window["type"] == "year", window["value"].cast("string")))
