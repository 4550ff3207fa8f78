"""Counts of users or occurrences over an event set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.args import as_flag, as_int, event_names, known_property, profile_condition
from paceline.operators.lookback import within

METRICS = ("unique_users", "event_count")
TOP_GROUPS = 12


def insight(
    log: DataFrame,
    users: DataFrame | None = None,
    *,
    events: str | Sequence[str],
    metric: str = "unique_users",
    group_by: str | None = None,
    by_week: Any = False,
    timeframe_days: Any = 90,
    filters: Mapping[str, Any] | None = None,
    properties: Sequence[str] = (),
    as_of: datetime | None = None,
) -> DataFrame:
    """The metric in total ``(group, value)``, per Monday week ``(week, value)`` or per property value.

    ``by_week`` wins over ``group_by``. Profiles are joined only for filters or grouping, so plain
    totals also count users without a profile. Grouping keeps the 12 largest groups and then
    drops the one without a value. Where profiles are joined the log is first reduced to one row
    per user (and week), which leaves no hot key in the join.
    """
    names = event_names(events, "events", 1, 20)
    metric = metric or "unique_users"
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    weekly = as_flag(by_week)
    prop = None if weekly or not group_by else known_property(group_by, properties)
    condition = profile_condition(filters, properties)

    rows = within(log, as_int(timeframe_days, 90), as_of).filter(F.col("event").isin(names))
    dims = []
    if weekly:
        rows = rows.withColumn("week", F.date_trunc("week", "ts").cast("date"))
        dims = ["week"]

    if prop is None and condition is None:
        value = F.count_distinct("user_id") if metric == "unique_users" else F.count(F.lit(1))
        result = rows.groupBy(*dims).agg(value.alias("value"))
    else:
        if users is None:
            raise ValueError("filters and group_by need user profiles")
        cohort = users if condition is None else users.filter(condition)
        per_user = rows.groupBy("user_id", *dims).agg(F.count(F.lit(1)).alias("n"))
        value = F.count(F.lit(1)) if metric == "unique_users" else F.coalesce(F.sum("n"), F.lit(0))
        if prop is None:
            joined = per_user.join(cohort, "user_id", "left_semi")
        else:
            joined = per_user.join(cohort.select("user_id", F.col(prop).alias("group")), "user_id")
            dims = ["group"]
        result = joined.groupBy(*dims).agg(value.alias("value"))

    if weekly:
        return result.orderBy("week")
    if prop is None:
        return result.select(F.lit("all users").alias("group"), "value")
    top = result.orderBy(F.desc("value"), F.asc_nulls_last("group")).limit(TOP_GROUPS)
    return top.filter(F.col("group").isNotNull())


def insight_summary(rows: DataFrame, total: DataFrame) -> DataFrame:
    """One row: the total, the number of groups or weeks, and the latest week or the top group with its value."""
    weekly = "week" in rows.columns
    key = F.col("week").cast("string") if weekly else F.col("group")
    named = rows.select(key.alias("item"), "value", *(["week"] if weekly else []))
    if weekly:
        chosen = named.agg(F.count(F.lit(1)).alias("groups"), F.max_by(F.struct("item", "value"), "week").alias("top"))
    else:
        # Of equal values the least name.
        first = F.min(F.struct((-F.col("value")).alias("less"), "item", "value"))
        chosen = named.agg(F.count(F.lit(1)).alias("groups"), first.alias("top"))
    whole = total.select(F.col("value").alias("total"))
    return chosen.join(whole, F.lit(True), "left").select(
        "total", "groups", F.col("top.item").alias("item"), F.col("top.value").alias("item_value")
    )


def weekly_users(
    log: DataFrame, sets: Mapping[str, str | Sequence[str]], *, timeframe_days: Any = 90, as_of: datetime | str | None = None
) -> DataFrame:
    """``(week, <set> ...)``: distinct users of several event sets per Monday week, from one pass over the log.

    The log is reduced to one row per user and week, with a flag for each set, before weeks are counted.
    """
    listed = {name: event_names(events, name, 1, 20) for name, events in sets.items()}
    rows = within(log, as_int(timeframe_days, 90), as_of).filter(F.col("event").isin(sorted({e for x in listed.values() for e in x})))
    flags = [F.max(F.col("event").isin(events).cast("int")).alias(name) for name, events in listed.items()]
    per_user = rows.filter(F.col("user_id").isNotNull()).groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(*flags)
    return per_user.groupBy("week").agg(*[F.sum(name).alias(name) for name in listed]).orderBy("week")
