"""Exact, mergeable counts of distinct users: a bitmap of users for each day and event.

Users are numbered from 0 without gaps, in a table that only grows, so that bitmaps are dense: one of 32,768 users takes 4 KB. The states
of a day (as the log files it) are a partition that is written once the day is complete, or again if events came late; nothing but that
day is read for it. Users over any set of events and days are then the union of bitmaps, users with a property its section with theirs; no user
is ever shuffled again. A look-back that begins inside a date takes that date's events from the log.

One writer at a time. Rows without a user count as events, but are no user.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.args import as_flag, as_int, event_names, known_property, profile_condition
from paceline.operators.metrics import METRICS, TOP_GROUPS
from paceline.session import materialise

STATES = "date date, event string, bucket bigint, users binary, n bigint, newest {ts}, day date"
NUMBERS = "user_id {user_id}, number bigint"


def numbered(frame: DataFrame, key: str, first: int) -> DataFrame:
    """The distinct keys with numbers from ``first`` on, in the order of the keys; every range of keys is numbered by a task of its own."""
    parts = frame.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    # The id that counts rows holds the number of the range in its upper bits; written, so that it stands.
    placed = materialise(parts.select(key, F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("part", (before - F.col("start") + first).alias("shift")))  # a row for each range
    return placed.join(shifts, part == F.col("part")).select(key, (F.col("at") + F.col("shift")).alias("number"))


def bitmaps(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """``keys, bucket, users`` and further aggregates of rows with a ``number``, null where there is no user."""
    spread = rows.withColumn("bucket", F.bitmap_bucket_number("number")).withColumn("bit", F.bitmap_bit_position("number"))
    return spread.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("users"), *more)


def both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, bucket, users``: users that are in a bitmap of ``a`` and in one of ``b`` (distinct in ``keys, bucket`` each; ``a`` by bucket
    alone, or by keys that ``b`` lacks)."""
    pairs = a.withColumnRenamed("users", "ours").join(b.withColumnRenamed("users", "theirs"), "bucket")
    each = pairs.select(*keys, "bucket", F.explode(F.array("ours", "theirs")).alias("users"))
    return each.groupBy(*keys, "bucket").agg(F.bitmap_and_agg("users").alias("users"))


def users_of(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, value``: distinct users over all bitmaps of each key."""
    merged = states.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("users")), F.lit(0)).alias("value"))


class UserStates:
    """States of one log under one root."""

    def __init__(self, spark: SparkSession, root: str, ts_type: str = "timestamp_ntz", user_id_type: str = "bigint"):
        self.spark, self.root = spark, root.rstrip("/")
        self.states_schema, self.numbers_schema = STATES.format(ts=ts_type), NUMBERS.format(user_id=user_id_type)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def states(self) -> DataFrame:
        """``day, date, event, bucket, users, n, newest``; ``day`` is the log's, ``date`` that of the events."""
        return self._read("states", self.states_schema)

    def numbers(self) -> DataFrame:
        return self._read("numbers", self.numbers_schema)

    @staticmethod
    def _by_day(log: DataFrame) -> DataFrame:
        return log if "day" in log.columns else log.withColumn("day", F.col("ts").cast("date"))

    def add_days(self, log: DataFrame, days: Sequence[date] | None = None) -> None:
        """Write, or replace, the states of some days of the log, by default of all. New users get the next numbers."""
        rows = self._by_day(log)
        if days is not None:
            rows = rows.filter(F.col("day").isin(list(days)))
        # One row for each user, event and date, before users are looked up.
        per_user = rows.groupBy("user_id", "event", "day", F.col("ts").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
        per_user = materialise(per_user, "user-days")
        known = self.numbers()
        new = per_user.filter(F.col("user_id").isNotNull()).select("user_id").join(known, "user_id", "left_anti")
        first = known.agg(F.max("number")).first()[0]
        numbered(new, "user_id", 0 if first is None else first + 1).write.mode("append").parquet(f"{self.root}/numbers")
        found = per_user.join(self.numbers(), "user_id", "left")
        states = bitmaps(found, ["day", "date", "event"], F.sum("n").alias("n"), F.max("newest").alias("newest"))
        ordered = states.select("date", "event", "bucket", "users", "n", "newest", "day").repartition("day")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/states")

    def _recent(self, log: DataFrame, names: list[str], days: int) -> DataFrame:
        """``date, bucket, users, n`` of a look-back: states of whole dates, and the rest of the date in which it begins from the log."""
        states = self.states()
        oldest = states.agg((F.max("newest") - F.make_dt_interval(F.lit(days))).alias("oldest")).first()["oldest"]
        if oldest is None:
            return states.select("date", "bucket", "users", "n")
        cutoff = F.lit(oldest).cast(log.schema["ts"].dataType)
        begun = cutoff.cast("date")
        chosen = states.filter((F.col("date") > begun) & F.col("event").isin(names)).select("date", "bucket", "users", "n")
        filed = [r["day"] for r in states.filter(F.col("date") == begun).select("day").distinct().collect()]  # one, or some late ones
        rest = self._by_day(log).filter(F.col("day").isin(filed) & (F.col("ts") >= cutoff) & (F.col("ts").cast("date") == begun) & F.col("event").isin(names))
        per_user = rest.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(self.numbers(), "user_id", "left")
        return chosen.unionByName(bitmaps(per_user, [], F.sum("n").alias("n")).select(begun.alias("date"), "bucket", "users", "n"))

    def insight(
        self, log: DataFrame, users: DataFrame | None = None, *, events: str | Sequence[str], metric: str = "unique_users", group_by: str | None = None,
        by_week: Any = False, timeframe_days: Any = 90, filters: Mapping[str, Any] | None = None, properties: Sequence[str] = (),
    ) -> DataFrame:
        """What ``operators.metrics.insight`` gives, from the states. Events of users with some property can't be told from them: such counts
        need the log."""
        names = event_names(events, "events", 1, 20)
        metric = metric or "unique_users"
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        weekly = as_flag(by_week)
        prop = None if weekly or not group_by else known_property(group_by, properties)
        condition = profile_condition(filters, properties)
        recent = self._recent(log, names, as_int(timeframe_days, 90))
        dims = ["week"] if weekly else []
        if weekly:
            recent = recent.withColumn("week", F.date_trunc("week", "date").cast("date"))
        if prop is None and condition is None:
            result = users_of(recent, dims) if metric == "unique_users" else recent.groupBy(*dims).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
        else:
            if users is None:
                raise ValueError("filters and group_by need user profiles")
            if metric != "unique_users":
                raise ValueError("the states hold users by property, not their events")
            cohort = users if condition is None else users.filter(condition)
            group = [] if prop is None else ["group"]
            members = cohort.select("user_id", *([] if prop is None else [F.col(prop).alias("group")])).join(self.numbers(), "user_id")
            merged = recent.filter(F.col("bucket").isNotNull()).groupBy(*dims, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
            met = both(merged, bitmaps(members, group), [*dims, *group])
            dims = [*dims, *group]
            result = users_of(met, dims)
            result = result.filter(F.col("value") > 0) if dims else result
        if weekly:
            return result.orderBy("week")
        if prop is None:
            return result.select(F.lit("all users").alias("group"), "value")
        top = result.orderBy(F.desc("value"), F.asc_nulls_last("group")).limit(TOP_GROUPS)
        return top.filter(F.col("group").isNotNull())
