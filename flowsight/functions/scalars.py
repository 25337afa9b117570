"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text (``Z``, ``+0000`` or an offset) to a timestamp; null when it is not one.

    Text without a zone is read in the session zone, which the package pins to UTC. A bare year or
    clock time, which a Spark cast would accept, is not a timestamp here.
    """
    return F.when(text.rlike(ISO_DATE), text.try_cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def iso_utc(seconds: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Epoch seconds to ISO-8601 text."""
    micros = F.floor(seconds * F.lit(1_000_000)).cast("long")
    return F.date_format(F.timestamp_micros(micros), pattern)


def number(text: Column) -> Column:
    """Trimmed text (or a number) as double; null when it does not parse."""
    return F.trim(text.cast("string")).try_cast("double")


def finite_or(value: Column, fallback: Column) -> Column:
    """``value`` with null, NaN and both infinities replaced by ``fallback``."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, fallback).otherwise(F.coalesce(value, fallback))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return out


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for an empty or missing denominator."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def code_point_sum(text: Column) -> Column:
    """Sum of the character codes of a string."""
    codes = F.transform(F.split(text, ""), F.ascii)
    return F.aggregate(codes, F.lit(0), lambda total, code: total + code)


def first_of(*candidates: Column) -> Column:
    """First non-null of several alternates of one field, the last being its default."""
    return F.coalesce(*candidates)


def exact_variance(n: Column, total: Column, total_squares: Column) -> Column:
    """Sample variance from whole-number sums, 0 for fewer than two rows.

    ``total_squares`` is a decimal, so the subtraction is exact and partial sums can be added and
    taken away in any order without drift.
    """
    total = total.cast("decimal(19,0)")
    spread = n.cast("decimal(15,0)") * total_squares - total * total
    pairs = n.cast("double") * (n - F.lit(1)).cast("double")
    return F.when(n > 1, F.greatest(F.lit(0.0), spread.cast("double")) / pairs).otherwise(F.lit(0.0))


def squared(value: Column) -> Column:
    """Exact square of a whole number."""
    wide = value.cast("decimal(19,0)")
    return (wide * wide).cast("decimal(38,0)")


SQUARE_BASE = 100_000  # squares are split at its square


def split_square(value: Column) -> dict[str, Column]:
    """Exact square of a whole number as two whole numbers that can be summed apart.

    Running sums of these are several times faster than of a wide decimal, and as exact.
    """
    base = F.lit(SQUARE_BASE).cast("long")
    low = F.pmod(value, base)
    high = ((value - low) / base).cast("long")
    cross = high * low * 2
    rest = F.pmod(cross, base)
    return {
        "square_high": high * high + ((cross - rest) / base).cast("long"),
        "square_low": rest * base + low * low,
    }


def join_square(high: str = "square_high", low: str = "square_low") -> Column:
    """Sum of squares as a decimal, from the sums of both parts."""
    wide = F.col(high).cast("decimal(19,0)") * F.lit(SQUARE_BASE**2).cast("decimal(11,0)")
    return (wide + F.col(low).cast("decimal(19,0)")).cast("decimal(38,0)")


def round_even(value: Column, digits: int) -> Column:
    """Round half to even after scaling, as numeric array libraries do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)
