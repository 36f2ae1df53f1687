"""Text helpers for landing and pattern rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    """NULL for text of nothing but white space."""
    return F.when(has_text(value), value)


def has_text(value: Column) -> Column:
    """True where some character is no white space. Cutting from the left alone ends at the first such one."""
    return F.ltrim(value, F.lit(" \t\r\n")) != ""


def clip(value: Column, width: int | Column) -> Column:
    """The first `width` characters; an over-long field is cut, not refused."""
    return F.when(F.octet_length(value) > width, F.left(value, F.lit(width))).otherwise(value)  # most are known short by their bytes


def like_any(value: Column, patterns: Iterable[str]) -> Column:
    """True when the text matches one of the patterns, ignoring case."""
    test = F.lit(False)
    for pattern in patterns:
        test = test | value.ilike(pattern)
    return test


def first_match(value: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """The value of the first (pattern, value) rule that matches, ignoring case."""
    out = None
    for pattern, result in rules:
        test = value.ilike(pattern)
        out = F.when(test, result) if out is None else out.when(test, result)
    return F.lit(default) if out is None else out.otherwise(default)


def by_value(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small fixed mapping as a CASE; NULL, or `default`, for anything unlisted."""
    out = None
    for key, result in table.items():
        test = value == key
        out = F.when(test, result) if out is None else out.when(test, result)
    if out is None:
        raise ValueError("empty mapping")
    return out if default is None else out.otherwise(default)
