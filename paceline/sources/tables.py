"""The two input tables and the views on them that need no operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.operators.lookback import micros_of


def event_log(
    table: DataFrame,
    user_id: str = "user_id",
    event: str = "event",
    ts: str = "ts",
    day: str | None = None,
    micros: str | None = None,
    late_days: int | None = None,
) -> DataFrame:
    """View any table as an event log. ``day`` names a date partition column, if there is one, and ``late_days`` says how many days
    after its time an event may be filed there; ``micros`` names the time as a number, if the table has it."""
    stamp = table.schema[ts].dataType
    if not isinstance(stamp, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{ts!r} must be a timestamp, is {stamp.simpleString()}")
    if not isinstance(table.schema[event].dataType, T.StringType):
        raise TypeError(f"{event!r} must be a string")
    columns = [F.col(user_id).alias("user_id"), F.col(event).alias("event"), F.col(ts).alias("ts")]
    if day:
        columns.append(F.col(day).alias("day", metadata={} if late_days is None else {"late_days": late_days}))
    if micros:
        columns.append(F.col(micros).cast("bigint").alias("micros"))
    return table.select(*columns)


def write_ordered_log(log: DataFrame, path: str, group_rows: int = 1_000_000) -> None:
    """Write a log so that look-backs read little: a folder for each day, rows inside it in the order of their time, which is also there as a
    number, and row groups of at most ``group_rows`` rows. Days that are already there are replaced."""
    timed = log.select("user_id", "event", "ts", micros_of(F.col("ts")).alias("micros"), F.col("ts").cast("date").alias("day"))
    ordered = timed.repartitionByRange("day", "micros").sortWithinPartitions("day", "micros")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.row.count.limit", group_rows)
    writer.partitionBy("day").parquet(path)


def read_ordered_log(spark: SparkSession, path: str, late_days: int = 0) -> DataFrame:
    """A log that ``write_ordered_log`` wrote; its days are those of the events, so none comes late."""
    return event_log(spark.read.parquet(path), day="day", micros="micros", late_days=late_days)


def user_profiles(table: DataFrame, properties: Sequence[str], user_id: str = "user_id") -> DataFrame:
    """View any table as profiles: a key and string properties."""
    return table.select(F.col(user_id).alias("user_id"), *[F.col(p).cast("string").alias(p) for p in properties])


def read_event_log(spark: SparkSession, path: str, **columns: str | None) -> DataFrame:
    return event_log(spark.read.parquet(path), **columns)


def read_user_profiles(spark: SparkSession, path: str, properties: Sequence[str], user_id: str = "user_id") -> DataFrame:
    return user_profiles(spark.read.parquet(path), properties, user_id)


def event_catalog(log: DataFrame) -> DataFrame:
    """Occurrences and distinct users per event name.

    Counted per (event, user) first, so the hottest event or user is combined map-side.
    """
    return (
        log.groupBy("event", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("event")
        .agg(F.sum("n").alias("occurrences"), F.count("user_id").alias("users"))
    )


def catalog_at(spark: SparkSession, path: str, **columns: str | None) -> dict[str, DataFrame | str]:
    """``rows``, the catalog of the log at a path, and a ``message``: a log that is not there has no events, and the message says so."""
    try:
        return {"rows": event_catalog(read_event_log(spark, path, **columns)), "message": ""}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], "event string, occurrences bigint, users bigint")
        return {"rows": empty, "message": f"there is no event log at {path}"}



def property_rows(properties: Sequence[str]) -> Column:
    """One (property, value) struct per property of a profile row, as an array."""
    return F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])


def property_values(users: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Distinct non-null values per property."""
    return users.select(F.inline(property_rows(properties))).filter(F.col("value").isNotNull()).distinct()
