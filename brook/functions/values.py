"""Scalar functions on text: folding, numbers, tokens and index keys.  All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """Strings compare without case; they are stored folded."""
    return F.lower(c)


def parse_long(c: Column) -> Column:
    """A signed 64-bit decimal; anything else, blanks around it included, is null."""
    return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("bigint"))


def parse_timestamp(c: Column) -> Column:
    """Milliseconds since 1970 as a timestamp."""
    return F.timestamp_millis(parse_long(c))


def tokens(c: Column) -> Column:
    """Folded words between white space."""
    return F.split(fold(c), r"\s+")


def zero_pad(c: Column, width: int) -> Column:
    """A number with zeros in front; never shortened."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def keys(c: Column, is_list: bool = False) -> Column:
    """The strings under which an index lists a value: one for a scalar, one for each element of a list."""
    if is_list:
        return F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))
