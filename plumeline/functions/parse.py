"""Lenient conversions of payload scalars: what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIRE_CONFIDENCE


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def choice(of: Column, table: dict[str, str | float]) -> Column:
    """The table's value for `of`, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), of)


def to_double(text: Column) -> Column:
    """A number; Java's type suffixes (1.5d, 1.5f) are no part of one."""
    return F.when(~text.rlike("(?i)[0-9.][df]\\s*$"), text.try_cast("double"))


def epoch_seconds(text: Column) -> Column:
    """Whole positive seconds since 1970 as a timestamp."""
    seconds = text.try_cast("bigint")
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def iso_timestamp(text: Column) -> Column:
    """An ISO date or time; without an offset it is UTC (the session's zone)."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(text).try_cast("timestamp"))


def hour_of_date(date: Column, hour: Column) -> Column:
    """Date and hour as UTC; a missing hour is 0."""
    return F.try_to_timestamp(F.concat_ws(" ", stripped(date), F.coalesce(hour.try_cast("int").cast("string"), F.when(hour.isNull(), "0"))), F.lit("y-M-d H"))


def acquisition_time(date: Column, hhmm: Column) -> Column:
    """Date and HHMM without leading zeros as UTC; an empty time is midnight."""
    padded = F.when(F.length(hhmm) >= 4, hhmm).otherwise(F.lpad(hhmm, 4, "0"))
    return F.when((F.length(date) > 0) & padded.rlike("^[0-9]{4}$"), F.try_to_timestamp(F.concat_ws(" ", date, padded), F.lit("y-M-d HHmm")))


def fire_confidence(text: Column) -> Column:
    """Percent: a letter or word of the fixed scale, or a number."""
    return F.coalesce(choice(F.lower(stripped(text)), FIRE_CONFIDENCE), to_double(text))


def precipitation(rain: Column, snow: Column) -> Column:
    """Rain and snow of an hour together; what is missing or no number is 0."""
    return F.coalesce(to_double(rain), F.lit(0.0)) + F.coalesce(to_double(snow), F.lit(0.0))


def is_outdoor(location_type: Column) -> Column:
    return location_type.isNull() | location_type.isin("0", "0.0", "false")
