"""Instants written as text: ISO date-times in several spellings, or epoch numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2})?)(?:[.,](\d{1,9}))?\s*([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})?\s*$"
_EPOCH = r"^\s*(\d{10,17})(?:\.\d+)?\s*$"


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 (UTC) of a written instant; NULL if the text is no date-time.

    Accepts ``YYYY-MM-DD`` + ``T`` or a blank + ``hh:mm[:ss[.fraction]]`` + ``Z``, ``+hh``, ``+hhmm``
    or ``+hh:mm`` (no zone counts as UTC), and epoch seconds, milliseconds or microseconds, told apart
    by their number of digits. NULL, empty, cut or impossible dates (``0000-00-00``) give NULL.
    """
    zone = F.regexp_extract(text, _ISO, 4)
    zone = F.when(zone.isin("", "Z", "z"), F.lit("+00:00")).otherwise(
        F.concat(F.substring(zone, 1, 3), F.lit(":"), F.when(F.length(zone) > 3, F.substring(zone, -2, 2)).otherwise(F.lit("00")))
    )
    clock = F.regexp_extract(text, _ISO, 2)
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    fraction = F.substring(F.rpad(F.regexp_extract(text, _ISO, 3), 6, "0"), 1, 6)
    iso = F.concat(F.regexp_extract(text, _ISO, 1), F.lit("T"), clock, F.lit("."), fraction, zone)
    number = F.regexp_extract(text, _EPOCH, 1)
    digits = F.length(number)
    n = number.try_cast("bigint")
    epoch = F.when(digits <= 11, n * 1_000_000).when(digits <= 14, n * 1_000).otherwise(n)
    return F.when(text.rlike(_ISO), F.unix_micros(iso.try_cast("timestamp"))).when(text.rlike(_EPOCH), epoch)
