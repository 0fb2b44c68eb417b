"""Epoch-second expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86400
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a zone-less timestamp read as UTC, rounded down."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * _DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_year(seconds: Column, zone: str = "UTC") -> Column:
    """Calendar year of an epoch-second value in ``zone``.

    Strings are accepted; what is not a whole number, or lies outside the years
    1 to 9999 in UTC, gives null in every zone instead of failing the job.
    """
    whole = seconds.try_cast("bigint")
    whole = F.when(whole.between(FIRST_SECOND, LAST_SECOND), whole)
    in_day = F.pmod(whole, F.lit(_DAY).cast("bigint"))
    date = F.date_from_unix_date(((whole - in_day) / _DAY).try_cast("int"))
    if zone == "UTC":
        return F.year(date)
    utc = F.timestamp_add("SECOND", in_day.cast("int"), date.cast("timestamp_ntz"))
    return F.year(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
