"""Text columns: page text from fragments, and values that fit a declared type."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_text(items: Column) -> Column:
    """The fragments joined by one space, nothing trimmed; null fragments count as empty, and no fragments give ''."""
    return F.array_join(items, " ", "")


def page_numbers(n: Column) -> Column:
    """1 to n, nothing for less than 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def too_long(value: Column, limit: int) -> Column:
    """Whether value exceeds a varchar's limit by anything but spaces."""
    return F.char_length(F.rtrim(value)) > limit


def fitted(value: Column, limit: int) -> Column:
    """value without the spaces beyond the limit."""
    return F.when(F.char_length(value) > limit, F.substring(value, 1, limit)).otherwise(value)


def number_in(value: Column) -> Column:
    """A number written with thousands separators as decimal(38,10); null if it isn't one."""
    return F.replace(value, F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def decimal_in(value: Column, precision: int, scale: int) -> Column:
    """A number as decimal(precision, scale), rounded half away from zero; null if it doesn't fit. The range is tested first: a try_cast that fails throws and catches."""
    kind = f"decimal({precision},{scale})"
    if precision > 20:  # a limit that a decimal can't hold
        return value.try_cast(kind)
    return F.when(F.abs(value) < F.lit(Decimal(10) ** (precision - scale) - Decimal(5).scaleb(-scale - 1)), value.cast(kind))


def percent_in(value: Column) -> Column:
    return decimal_in(value, 5, 2)


def name_key(value: Column) -> Column:
    """What spellings of a name have in common: case, white space and ASCII punctuation don't count."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\p{Punct}\s]+", " "))


def iso_millis(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, as timestamps are sent to clients."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
