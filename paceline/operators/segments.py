"""Segment definition, event discovery and profiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.args import as_float, as_int, profile_condition, required_text
from paceline.functions.numeric import round_exact, share
from paceline.operators.lookback import cutoff, within
from paceline.session import materialise
from paceline.sources.tables import property_rows

# Fixed values of the analyses.
SHARE_FLOOR = 0.005  # least population share a lift is divided by
CHANGE_FLOOR = 0.01  # least population share a relative change is divided by
LEAST_SEGMENT_SHARE = 0.02  # a profile value must be held by this share of the segment
ZERO_LIFT = 1e-4  # stands for a lift of zero when ranking


def _sized(counts: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Counts with the two cohort sizes, one-row frames, alongside."""
    segment_size = members.agg(F.count(F.lit(1)).alias("segment_size"))
    population_size = users.agg(F.count(F.lit(1)).alias("population_size"))
    return counts.crossJoin(F.broadcast(segment_size)).crossJoin(F.broadcast(population_size))


def define_segment(
    log: DataFrame,
    users: DataFrame,
    *,
    filters: Mapping[str, Any] | None = None,
    event_filters: Sequence[Mapping[str, Any]] = (),
    properties: Sequence[str] = (),
    as_of: datetime | None = None,
) -> DataFrame:
    """``user_id`` of the profiled users that meet all property filters and all event rules.

    A rule is ``{event, op: at_least | at_most, count, timeframe_days}``; no events count as 0.
    All rules are counted in one aggregation over the log, whatever their number.
    """
    condition = profile_condition(filters, properties)
    cohort = (users if condition is None else users.filter(condition)).select("user_id")
    if not event_filters:
        return cohort

    rules = []
    for rule in event_filters:
        op = str(rule.get("op") or "at_least")
        if op not in ("at_least", "at_most"):
            raise ValueError(f"event rule op must be at_least or at_most, got {op!r}")
        event = required_text(rule.get("event"), "an event rule's event")
        rules.append((event, op, as_int(rule.get("count"), 1), as_int(rule.get("timeframe_days"), 90)))

    longest = max(days for *_, days in rules)
    rows = within(log, longest, as_of).filter(F.col("event").isin(sorted({r[0] for r in rules})))
    counts, kept = [], None
    for i, (event, op, least, days) in enumerate(rules):
        hit = F.col("event") == event
        if days != longest:
            hit = hit & (F.col("ts") >= cutoff(log, days, as_of))
        counts.append(F.count_if(hit).alias(f"n{i}"))
        seen = F.coalesce(F.col(f"n{i}"), F.lit(0))
        test = seen >= least if op == "at_least" else seen <= least
        kept = test if kept is None else kept & test
    per_user = rows.groupBy("user_id").agg(*counts)
    return cohort.join(per_user, "user_id", "left").filter(kept).select("user_id")


def _flagged(rows: DataFrame, segments: Sequence[DataFrame]) -> DataFrame:
    """Rows of users with ``member_0``, ``member_1``, ... that are null for users outside a segment."""
    members = [s.select("user_id", F.lit(k).alias("k")) for k, s in enumerate(segments)]
    listed = members[0]
    for more in members[1:]:
        listed = listed.unionByName(more)
    flags = [F.max(F.when(F.col("k") == k, 1)).alias(f"member_{k}") for k in range(len(segments))]
    return rows.join(listed.groupBy("user_id").agg(*flags), "user_id", "left")


def discover_together(
    log: DataFrame,
    users: DataFrame,
    segments: Sequence[DataFrame],
    *,
    top_n: Any = 15,
    timeframe_days: Any = 90,
    as_of: datetime | str | None = None,
) -> list[DataFrame]:
    """``discover_events`` for several segments from one pass over the log, whose counts are written."""
    pairs = within(log, as_int(timeframe_days, 90), as_of).select("user_id", "event").distinct()
    members = [F.count(f"member_{k}").alias(f"segment_users_{k}") for k in range(len(segments))]
    counts = _flagged(pairs, segments).groupBy("event").agg(F.count("user_id").alias("population_users"), *members)
    counts = materialise(counts, "event-counts")
    return [_distinctive(counts.withColumn("segment_users", F.col(f"segment_users_{k}")), s, users, top_n) for k, s in enumerate(segments)]


def _distinctive(counts: DataFrame, segment: DataFrame, users: DataFrame, top_n: Any) -> DataFrame:
    shares = _sized(counts, segment.select("user_id").distinct(), users).select(
        "event",
        share("segment_users", "segment_size").alias("segment_pct"),
        share("population_users", "population_size").alias("population_pct"),
    )
    lift = f"segment_pct / greatest(population_pct, {SHARE_FLOOR}D)"
    scored = shares.withColumn("lift", round_exact(lift))
    distance = F.abs(F.ln(F.when(F.col("lift") > 0, F.col("lift")).otherwise(F.lit(ZERO_LIFT))))
    return scored.orderBy(distance.desc(), "event").limit(as_int(top_n, 15))


def discover_events(
    log: DataFrame,
    users: DataFrame,
    segment: DataFrame,
    *,
    top_n: Any = 15,
    timeframe_days: Any = 90,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Events over- or under-used by a segment, most distinctive first.

    The log is reduced to distinct (user, event) before it meets the segment. Population counts
    come from the log, the population size from the profiles.
    """
    pairs = within(log, as_int(timeframe_days, 90), as_of).select("user_id", "event").distinct()
    counts = _flagged(pairs, [segment]).groupBy("event").agg(
        F.count("user_id").alias("population_users"), F.count("member_0").alias("segment_users")
    )
    return _distinctive(counts, segment, users, top_n)


def discovery_summary(discovery: DataFrame) -> DataFrame:
    """The one event to name: the most over-used, or if there is none the most under-used."""
    over = F.col("lift") >= 1
    strength = F.when(over, -F.col("lift")).otherwise(F.col("lift"))
    return (
        discovery.orderBy(over.desc(), strength, "event")
        .limit(1)
        .select(F.when(over, "over").otherwise("under").alias("direction"), "event", "segment_pct", "population_pct", "lift")
    )


def _value_counts(users: DataFrame, segments: Sequence[DataFrame], properties: Sequence[str]) -> DataFrame:
    members = [f"member_{k}" for k in range(len(segments))]
    return (
        _flagged(users, segments)
        .select(*members, F.inline(property_rows(properties)))
        .groupBy("property", "value")
        .agg(F.count(F.lit(1)).alias("population_users"), *[F.count(m).alias(f"segment_users_{k}") for k, m in enumerate(members)])
        .filter(F.col("value").isNotNull())
    )


def _deviations(counts: DataFrame, segment: DataFrame, users: DataFrame, min_relative_change: Any) -> DataFrame:
    shares = _sized(counts, segment.select("user_id").distinct(), users).select(
        "property",
        "value",
        share("segment_users", "segment_size").alias("segment_pct"),
        share("population_users", "population_size").alias("population_pct"),
    )
    change = f"(segment_pct - population_pct) / greatest(population_pct, {CHANGE_FLOOR}D)"
    return (
        shares.withColumn("relative_change", round_exact(change))
        .filter(F.abs("relative_change") >= as_float(min_relative_change, 0.3))
        .filter(F.col("segment_pct") >= LEAST_SEGMENT_SHARE)
        .orderBy(F.abs("relative_change").desc(), "property", "value")
    )


def profile_segment(
    users: DataFrame, segment: DataFrame, properties: Sequence[str], *, min_relative_change: Any = 0.3
) -> DataFrame:
    """Property values whose share in the segment departs from the population, largest change first."""
    counts = _value_counts(users, [segment], properties).withColumnRenamed("segment_users_0", "segment_users")
    return _deviations(counts, segment, users, min_relative_change)


def profile_together(
    users: DataFrame, segments: Sequence[DataFrame], properties: Sequence[str], *, min_relative_change: Any = 0.3
) -> list[DataFrame]:
    """``profile_segment`` for several segments from one pass over the profiles, whose counts are written."""
    counts = materialise(_value_counts(users, segments, properties), "value-counts")
    return [
        _deviations(counts.withColumn("segment_users", F.col(f"segment_users_{k}")), s, users, min_relative_change)
        for k, s in enumerate(segments)
    ]


def profile_summary(deviations: DataFrame, segment: DataFrame) -> DataFrame:
    """One row: the segment's size and its strongest deviation, if it has one."""
    size = segment.select("user_id").distinct().agg(F.count(F.lit(1)).alias("segment_size"))
    top = deviations.orderBy(F.abs("relative_change").desc(), "property", "value").limit(1)
    return size.join(top, F.lit(True), "left")
