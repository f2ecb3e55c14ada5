"""Column functions on numbers and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column) -> Column:
    """As double; null, unparsable text and NaN become 0."""
    number = value.try_cast("double")
    return F.when(F.isnan(number), F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.0)))


def log_score(score: Column) -> Column:
    """log2 of the score, floored at 0.01."""
    return F.log2(F.greatest(score, F.lit(0.01)))


def epoch_to_utc(seconds: Column) -> Column:
    """Epoch seconds as 'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100
