"""Week windows and timestamps; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(text: Column) -> Column:
    """ISO text (``Z``, an offset, or naive = UTC, any fraction) as a timestamp; null where it can't be read."""
    return F.coalesce(text.try_cast("timestamp"), F.substring(text, 1, 19).try_cast("timestamp"))


def parse_any_date(text: Column) -> Column:
    """ISO text, or the older ``Wed Aug 15 01:22:19 +0000 2012``, as a timestamp."""
    old = F.when(text.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d"), F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")))
    return F.coalesce(old, parse_utc(text))


def iso(ts: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ssZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def week_start(ts: Column) -> Column:
    """The Monday of a timestamp's week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def window_end(monday: Column) -> Column:
    """The Monday after: windows are half open."""
    return F.date_add(monday, 7)


def in_window(ts: Column, monday: str) -> Column:
    """Timestamps of the week that begins at ``monday``."""
    return (ts >= F.lit(monday).cast("timestamp")) & (ts < F.lit(monday).cast("timestamp") + F.expr("INTERVAL 7 DAYS"))


def year_week(ts: Column) -> Column:
    """Year and number of the week from the year's first Monday (00 before it); parts at year ends, unlike windows."""
    return F.concat(F.year(ts), F.lit("-"), F.lpad(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string"), 2, "0"))
