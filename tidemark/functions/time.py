"""Exact microsecond arithmetic on timestamps and wall times, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp that holds UTC."""
    t = ts.cast("timestamp_ntz")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    return F.unix_date(t.cast("date")).cast("bigint") * US_PER_DAY + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
