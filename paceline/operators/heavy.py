"""Splitting off the users that hold too many events for one task.

Operators that need a user's events in order collect them per user. That is fine for
almost everybody; a crawler or a shared account may hold a large part of the log, and is
worked on in slices of a measured number of rows instead.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from paceline.session import materialise, scratch_path


@dataclass(frozen=True)
class SkewPolicy:
    """A user with more than ``min_rows`` rows is heavy, whatever the size of the log.

    ``slice_rows`` bounds the rows of a heavy user that meet in one group. ``known`` holds the heavy users once they are
    found; ``nobody`` says that there are none, and their branch is then left out of the plan.
    """

    min_rows: int = 100_000
    slice_rows: int = 20_000
    known: DataFrame | None = None
    nobody: bool = False

    def heavy_users(self, rows: DataFrame) -> DataFrame:
        if self.known is not None:
            return self.known
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > self.min_rows).select("user_id")

    def split(self, rows: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(light, heavy) rows, both only of ``members`` if given; heavy is None if there is nobody.

        Rows without a user are rows of one user, the missing one. The list of heavy users is as long as the log makes it:
        adaptive execution decides whether to broadcast it.
        """
        if members is not None:
            rows = rows.join(members, "user_id", "left_semi")
        if self.nobody:
            return rows, None
        heavy = self.heavy_users(rows).withColumnRenamed("user_id", "heavy_id")
        same = rows["user_id"].eqNullSafe(heavy["heavy_id"])
        return rows.join(heavy, same, "left_anti"), rows.join(heavy, same, "left_semi")


DEFAULT_SKEW = SkewPolicy()


def survey(log: DataFrame, as_of: datetime | str | None, skew: SkewPolicy) -> tuple[datetime | str | None, SkewPolicy]:
    """The newest time of a log and its heavy users, found in one pass over ``(user_id, ts)``; what is given stays.

    Runs a job unless both are given. Users are counted over all rows of ``log``; that a user is called heavy who
    has few rows in a look-back does no harm.
    """
    if as_of is not None and (skew.known is not None or skew.nobody):
        return as_of, skew
    spark, seen = log.sparkSession, Observation()
    per_user = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("newest"))
    heavy = F.col("n_rows") > skew.min_rows
    observed = per_user.observe(seen, F.max("newest").cast("string").alias("newest"), F.count_if(heavy).alias("heavy"))
    path = scratch_path(spark, "heavy-users")
    observed.filter(heavy).select("user_id").write.parquet(path)
    found = seen.get
    if skew.known is None and not skew.nobody:
        known = spark.read.schema(per_user.select("user_id").schema).parquet(path)
        skew = replace(skew, known=known, nobody=not found.get("heavy"))
    return found.get("newest") if as_of is None else as_of, skew


#: How many tables of moves are composed at a time.
COMPOSED = 32


def composed(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, moves``: the tables of all slices of a key, one after the other, as one table.

    ``tables`` has ``keys``, ``slice`` and ``moves``: arrays that say for each state before a slice (its place) the state after it, one
    array for each thing that is followed. Tables are small, whatever a slice holds; they are composed in groups of ``COMPOSED`` until one is
    left. Runs a job for each level.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("slice")) - 1
    level = materialise(tables.select(*keys, "slice", "moves").withColumn("nth", nth).drop("slice"), "moves")
    chained = F.transform(
        F.get("parts", F.lit(0))["moves"],
        lambda first, p: F.transform(
            F.sequence(F.lit(0), F.size(first) - 1),
            lambda m: F.aggregate("parts", m, lambda at, part: F.get(F.get(part["moves"], p), at)),
        ),
    )
    longest = level.agg(F.max("nth")).first()[0] or 0
    while longest > 0:
        grouped = level.groupBy(*keys, F.expr(f"cast(nth div {COMPOSED} as int)").alias("nth")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("nth").alias("k"), "moves"))).alias("parts")
        )
        level = materialise(grouped.select(*keys, "nth", chained.alias("moves")), "moves")
        longest //= COMPOSED
    return level.select(*keys, "moves")
