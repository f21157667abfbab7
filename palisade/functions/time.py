"""Time arithmetic on TIMESTAMP_NTZ that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp."""
    minutes = (
        F.unix_date(ts.cast("date")).cast("bigint") * 1440
        + F.hour(ts).cast("bigint") * 60
        + F.minute(ts)
    )
    return minutes * (60 * MICROS) + (F.extract(F.lit("SECOND"), ts) * MICROS).cast("bigint")


def time_slice(micros: Column, seconds: int) -> Column:
    """Start, in microseconds, of the slice that holds the time."""
    return micros - F.pmod(micros, F.lit(seconds * MICROS).cast("bigint"))


def iso_format(ts: Column) -> Column:
    """ISO-8601; the fraction is printed, with six digits, only when it is not zero."""
    has_fraction = F.extract(F.lit("SECOND"), ts) % 1 != 0
    return F.when(has_fraction, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    )
