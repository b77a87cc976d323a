"""Missing-value, number and time rules shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attr(attributes: str | Column, key: str) -> Column:
    """Map element; a missing key or map is the empty text."""
    return F.coalesce(col(attributes)[key], F.lit(""))


def or_default(c: str | Column, default: str | Column) -> Column:
    """The value, or the default where it is empty or NULL."""
    c = col(c)
    return F.when((c.isNotNull()) & (c != ""), c).otherwise(default if isinstance(default, Column) else F.lit(default))


def first_filled(columns: Sequence[Column], default: str = "") -> Column:
    """First non-empty text of the list, trimmed."""
    return F.trim(F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(default)))


# Whole numbers of 16 unsigned bits, leading zeros allowed.
_UINT16 = "^0*([0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"


def uint16_or_zero(text: str | Column) -> Column:
    """Text of digits up to 65535, else 0 (no blanks, signs or fractions)."""
    text = col(text)
    return F.coalesce(F.when(text.rlike(_UINT16), text).try_cast("int"), F.lit(0))


def uint_or_zero(text: str | Column) -> Column:
    """Text of digits within BIGINT, else 0."""
    text = col(text)
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text).try_cast("bigint"), F.lit(0).cast("bigint"))


def float_or_zero(text: str | Column) -> Column:
    """Plain or exponent decimal text, else 0."""
    text = col(text)
    number = F.when(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast("double")
    return F.coalesce(number, F.lit(0.0))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def micros(ts: str | Column) -> Column:
    """Event time as microseconds since the epoch."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column, like: str = "timestamp_ntz") -> Column:
    return F.timestamp_micros(us).cast(like)


def at(instant: str | Column) -> Column:
    """A point in time given as text or column."""
    return F.lit(instant).cast("timestamp_ntz") if isinstance(instant, str) else instant


def before(instant: str | Column, amount: float, unit: str = "SECOND") -> Column:
    seconds = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}[unit] * amount
    return at(instant) - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))


def bucket(ts: str | Column, unit: str, tz: str = "UTC") -> Column:
    """Start of the minute, hour or day on the clock of `tz`."""
    local = col(ts).cast("timestamp_ntz")
    if tz != "UTC":
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), local)
    return F.date_trunc(unit, local).cast("timestamp_ntz")


def contains_ci(text: str | Column, needle: str) -> Column:
    """Case-insensitive literal substring; no wildcard characters."""
    return F.contains(F.lower(col(text)), F.lit(needle.lower()))


def time_bounded(df: DataFrame, start: str | Column | None = None, end: str | Column | None = None,
                 ts: str = "Timestamp", date: str = "log_date",
                 open_start: bool = False, open_end: bool = False) -> DataFrame:
    """Bound event time, and the day partition too where the table has one.

    A predicate on the time alone does not prune day partitions, so both are stated.
    """
    dated = date in df.columns
    if start is not None:
        low = at(start)
        df = df.filter(F.col(ts) > low if open_start else F.col(ts) >= low)
        if dated:
            df = df.filter(F.col(date) >= F.to_date(low))
    if end is not None:
        high = at(end)
        df = df.filter(F.col(ts) < high if open_end else F.col(ts) <= high)
        if dated:
            df = df.filter(F.col(date) <= F.to_date(high))
    return df
