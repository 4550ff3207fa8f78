"""Mining the property values that help or hinder a funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.args import as_int, funnel_steps
from paceline.functions.numeric import round_exact, share
from paceline.sources.tables import property_rows

# Fixed values of the analysis.
LEAST_USERS = 50
LEAST_FRACTION = 0.01
MOST_ENTRIES = 5
ALL = "*"  # pseudo property that carries the base of a cohort


def value_counts(
    users: DataFrame, properties: Sequence[str], keys: Sequence[str], kept: Sequence[str], counts: Sequence[Column]
) -> DataFrame:
    """Aggregates over the ``kept`` columns per (keys, property, value), with the pseudo property ALL."""
    base = F.array(F.struct(F.lit(ALL).alias("property"), F.lit(None).cast("string").alias("value")))
    cells = F.concat(base, property_rows(properties)) if properties else base
    return users.select(*keys, *kept, F.inline(cells)).groupBy(*keys, "property", "value").agg(*counts)


def score_values(values: DataFrame, keys: Sequence[str], max_values: int) -> DataFrame:
    """Conversion, lift and impact of the candidate values of each cohort in ``keys``.

    ``values`` has ``start_users``, ``end_users`` and the cohort's ``base_users`` and
    ``base_conversion``. Candidates are the ``max_values`` largest values of a property (a row-number
    limit, which Spark also applies before the shuffle) that hold enough users.
    """
    largest = Window.partitionBy(*keys, "property").orderBy(F.desc("start_users"), "value")
    floor = F.greatest(F.lit(LEAST_USERS), F.ceil(F.lit(LEAST_FRACTION) * F.col("base_users")))
    scored = (
        values.filter(F.col("value").isNotNull() & (F.col("start_users") > 0))
        .withColumn("rank", F.row_number().over(largest))
        .filter((F.col("rank") <= max_values) & (F.col("start_users") >= floor))
        .withColumn("conversion", share("end_users", "start_users"))
        .withColumn("lift", round_exact("conversion - base_conversion"))
    )
    return scored.select(
        *keys,
        "property",
        "value",
        "conversion",
        "lift",
        F.col("start_users").alias("affected_users"),
        round_exact("start_users * abs(lift)", 1).alias("impact"),
        "base_users",
        "base_conversion",
    )


def breakdown_entries(
    reach: DataFrame,
    users: DataFrame,
    steps: str | Sequence[str],
    properties: Sequence[str],
    *,
    filters: Mapping[str, Any] | None = None,
    max_values_per_property: Any = 8,
) -> DataFrame:
    """Every candidate property value with its conversion, lift and impact.

    ``reach`` must come from the same steps and filters; filtered properties are skipped. All
    properties are counted in one aggregation, the base included.
    """
    n = len(funnel_steps(steps))
    open_properties = [p for p in properties if p not in (filters or {})]
    joined = reach.filter(F.col("reached") >= 1).join(users.select("user_id", *open_properties), "user_id")
    totals = [F.count(F.lit(1)).alias("start_users"), F.count_if(F.col("reached") >= n).alias("end_users")]
    counts = value_counts(joined, open_properties, [], ["reached"], totals)
    base = counts.filter(F.col("property") == ALL).select(
        F.col("start_users").alias("base_users"), share("end_users", "start_users").alias("base_conversion")
    )
    values = counts.filter(F.col("property") != ALL).crossJoin(F.broadcast(base))  # one row, or none
    return score_values(values, [], as_int(max_values_per_property, 8))


def top_entries(entries: DataFrame, keys: Sequence[str] = (), most: int = MOST_ENTRIES) -> DataFrame:
    """The strongest boosters and blockers by impact; values without lift are neither."""
    side = F.when(F.col("lift") > 0, "booster").when(F.col("lift") < 0, "blocker")
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("impact"), "property", "value")
    return (
        entries.withColumn("kind", side)
        .filter(F.col("kind").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
    )


def breakdown_summary(reach: DataFrame, steps: str | Sequence[str], entries: DataFrame) -> DataFrame:
    """One row: the base users and conversion, and the strongest blocker, or else the strongest booster, if there is one."""
    n = len(funnel_steps(steps))
    base = reach.agg(
        F.count_if(F.col("reached") >= 1).alias("base_users"), F.count_if(F.col("reached") >= n).alias("end_users")
    ).select("base_users", share("end_users", "base_users").alias("base_conversion"))
    strongest = top_entries(entries, most=1)
    chosen = strongest.orderBy("kind").limit(1)  # "blocker" before "booster"
    return base.join(chosen.select("kind", "property", "value", "lift", "affected_users"), F.lit(True), "left")
