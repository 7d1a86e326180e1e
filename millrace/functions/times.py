"""Times: ISO texts in a zone and back, and spans of a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_in_zone(at: Column, zone: str = "UTC") -> Column:
    """A timestamp as ISO 8601 text with the zone's offset; microseconds where there are any. The
    session's time zone, in which timestamps are read, has to be UTC."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(at.cast("timestamp"))) / 60_000_000).cast("long")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    part = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(""), offset)


def epoch_of(iso: Column) -> Column:
    """Seconds since 1970 of an ISO text; null where it is none. Without an offset it is UTC."""
    return F.unix_micros(F.try_to_timestamp(iso)) / 1e6


def elapsed(first: Column, last: Column) -> Column:
    """Seconds between two timestamps, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6)
