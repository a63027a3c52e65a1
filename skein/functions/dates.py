"""Column functions over dates and times; none depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz_seconds(c: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp without zone, read as UTC."""
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("bigint")


def quarter_index(c: Column) -> Column:
    """year * 4 + quarter - 1, so that adjacent quarters differ by one."""
    return F.year(c) * 4 + F.quarter(c) - 1


def quarter_key(c: Column) -> Column:
    """YYYY-Qn."""
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
