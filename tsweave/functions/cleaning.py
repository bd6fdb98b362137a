"""Messy text to numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as part of a number.
NOT_DIGIT_OR_DOT = r"[^0-9.]"
DECORATION = r"[,\s$€£%]"
SIGNED_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(text: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return text.try_cast("double")


def clean_numeric(text: Column, signed: bool = False) -> Column:
    """Strip decoration from a number written as text and parse it.

    The default deletes every character but digits and the dot, so signs,
    exponents and percent signs vanish (``-5.2`` is 5.2 and ``1e-05`` is 105).
    ``signed=True`` removes only currency signs, separators, blanks and percent
    signs, and keeps sign and exponent.
    """
    if not signed:
        return to_double(F.regexp_replace(text, NOT_DIGIT_OR_DOT, ""))
    bare = F.regexp_replace(text, DECORATION, "")
    return F.when(bare.rlike(SIGNED_NUMBER), to_double(bare))


def nan_to_null(value: Column) -> Column:
    """Aggregates skip null but not NaN, so only null marks a missing value."""
    return F.when(~F.isnan(value), value)


def to_float32(value: Column) -> Column:
    """Narrow to single precision."""
    return value.cast("float")
