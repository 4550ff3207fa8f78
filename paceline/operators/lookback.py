"""Look-back windows anchored at the newest event of the whole log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.heavy import SkewPolicy, survey

#: How many days after its time an event may be filed under ``day``, at most, for the newest one to be found; a log may say otherwise.
LATE_DAYS = 7


def _late_days(log: DataFrame) -> int:
    return int(log.schema["day"].metadata.get("late_days", LATE_DAYS))


def micros_of(ts: Column) -> Column:
    """A time as a whole number, for stamps with and without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def cutoff(log: DataFrame, days: int, as_of: datetime | str | None = None) -> Column:
    """Oldest time inside the look-back.

    A scalar subquery, evaluated once before the scan that uses it, so the comparison is
    pushed into that scan as a value. ``as_of`` gives the newest time (text is read in the session's time zone), if it is known,
    and saves the pass over ``ts``. If the log is partitioned by ``day``, only the newest day and the days before it under which an event may be
    filed late are searched: the newest event may lie under an earlier day than one that came in late.
    """
    span = F.make_dt_interval(F.lit(int(days)))
    if as_of is not None:
        return F.lit(as_of).cast(log.schema["ts"].dataType) - span
    return _newest_part(log).select(F.max("ts") - span).scalar()


def _newest_part(log: DataFrame) -> DataFrame:
    if "day" not in log.columns:
        return log
    return log.filter(F.col("day") >= log.select(F.date_sub(F.max("day"), _late_days(log))).scalar())


def within(log: DataFrame, days: int, as_of: datetime | str | None = None) -> DataFrame:
    """Events of the last ``days`` days, the cut-off included.

    A log with ``day`` is pruned by it. ``day`` may be the date of the event in any time zone or a later one, as that of its
    arrival; a day is left as a margin for the zone. A log with ``micros``, the time as a number, is compared by that: Spark has Parquet skip
    row groups by numbers, but not by stamps without a zone.
    """
    oldest = cutoff(log, days, as_of)
    if "micros" in log.columns:
        span = int(days) * 86_400_000_000
        known = as_of is not None
        least = micros_of(F.lit(as_of).cast(log.schema["ts"].dataType)) - span if known else _newest_part(log).select(F.max("micros") - span).scalar()
        recent = log.filter(F.col("micros") >= least)
    else:
        recent = log.filter(F.col("ts") >= oldest)
    if "day" in log.columns:
        recent = recent.filter(F.col("day") >= F.date_sub(oldest.cast("date"), 1))
    return recent.select("user_id", "event", "ts")


def surveyed(log: DataFrame, days: int, as_of: datetime | str | None, skew: SkewPolicy) -> tuple[datetime | str | None, SkewPolicy]:
    """What ``survey`` finds for a look-back. A log with ``day`` is surveyed inside the look-back only, so that it is pruned."""
    return survey(within(log, days, as_of) if "day" in log.columns else log, as_of, skew)
