"""Product paths and journey maps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paceline.functions.args import as_int, name_list, path_ends
from paceline.functions.numeric import share
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy, composed
from paceline.operators.sequences import Journeys, journeys, path_counts, scoped_rows
from paceline.session import materialise

CANONICAL_PATHS = 5


def product_paths(
    log: DataFrame,
    start_event: str,
    end_event: str,
    *,
    allowed_events: str | Sequence[str] | DataFrame | None = None,
    top_n: Any = 10,
    timeframe_days: Any = 90,
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """The most-travelled paths from start to end with their users, and the users of all paths, ``completed_users``.

    Restricting the events always keeps the two ends. If nobody completed there is one row, without a path. Runs the
    surveying pass, and writes the counts by path.
    """
    start, end = path_ends(start_event, end_event)
    if isinstance(allowed_events, DataFrame):
        ends = allowed_events.sparkSession.createDataFrame([(start,), (end,)], "event string")
        allowed: Any = allowed_events.select("event").union(ends)
    else:
        names = name_list(allowed_events)
        allowed = sorted({*names, start, end}) if names else None
    rows = scoped_rows(log, timeframe_days=timeframe_days, allowed_events=allowed, as_of=as_of, skew=skew)
    return path_counts(journeys(rows, start, end), as_int(top_n, 10)).select("path", "users", "completed_users")


def product_paths_summary(paths: DataFrame) -> DataFrame:
    """One row: the users that completed, and the most travelled path."""
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("users"), "path")))
    return ranked.filter("rank = 1").select("completed_users", F.col("path").alias("top_path"), F.col("users").alias("top_users"))


def canonical_paths(found: Journeys) -> DataFrame:
    """The five most-travelled completed journeys."""
    return path_counts(found, CANONICAL_PATHS).filter(F.col("path").isNotNull()).select("events", "path", "users")


def _as_list(canonical: DataFrame) -> DataFrame:
    """The at most five canonical paths as one row: an array, the most travelled first."""
    item = F.struct((-F.col("users")).alias("order"), "path", "events")
    return canonical.agg(F.sort_array(F.collect_list(item)).alias("listed")).select(
        F.transform("listed", lambda p: p["events"]).alias("canonical")
    )


def _advance(events: Column, path: Column, matched: Column) -> Column:
    """How far a path is matched after these events, in order, from ``matched`` on."""
    return F.aggregate(
        events, matched, lambda m, event: m + F.when(event == F.get(path, m), F.lit(1)).otherwise(F.lit(0))
    )


def _best(matches: Column) -> Column:
    """Longest match; the more travelled path wins ties."""
    return F.array_max(
        F.transform(matches, lambda m, i: F.struct(m.alias("matched"), (-i).alias("order"), i.alias("path")))
    )


def align(found: Journeys, canonical: DataFrame) -> DataFrame:
    """``(path, matched, completed, users)``: how many users match which canonical path how far.

    Each user goes to the path matched furthest; ``path`` is its events, null where there is no
    canonical path. A heavy user's slices are turned, one by one, into tables "matched before ->
    matched after", whose size depends on the paths alone; these are composed.
    """
    listed = F.broadcast(_as_list(canonical))  # one row with at most five paths
    aligned = found.light.crossJoin(listed).select(
        "completed",
        "canonical",
        _best(F.transform("canonical", lambda path: _advance(F.col("events"), path, F.lit(0)))).alias("best"),
    )
    if found.steps is not None:
        chained = _composed(found.steps, listed)
        matched = F.transform("moves", lambda m: F.get(m, F.lit(0)))
        aligned = aligned.unionByName(chained.crossJoin(listed).select("completed", "canonical", _best(matched).alias("best")))
    return (
        aligned.groupBy("completed", F.col("best.matched").alias("matched"), F.get("canonical", F.col("best.path")).alias("path"))
        .agg(F.count(F.lit(1)).alias("users"))
    )


def _composed(steps: DataFrame, listed: DataFrame) -> DataFrame:
    """``(user_id, completed, moves)``: one table of moves per path and heavy user."""
    keys = ["user_id", "completed"]
    names = F.transform(F.sort_array(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"])
    moves = F.transform(
        "canonical",
        lambda path: F.transform(F.sequence(F.lit(0), F.size(path)), lambda m: _advance(F.col("names"), path, m)),
    )
    tables = steps.groupBy(*keys, "slice").agg(names.alias("names")).crossJoin(listed).select(*keys, "slice", moves.alias("moves"))
    return composed(tables, keys)


def _whole() -> WindowSpec:
    """All rows of an alignment: at most a few per step of the five paths."""
    return Window.partitionBy(F.lit(0))


def _find(log: DataFrame, start: str, end: str, segment: DataFrame | None, options: dict[str, Any]) -> Journeys:
    """The journeys, written: paths are counted and users aligned from one pass over the log."""
    start, end = path_ends(start, end)
    found = journeys(scoped_rows(log, segment=segment, **options), start, end)
    return Journeys(materialise(found.light, "journeys"), found.steps)


def _aligned_steps(found: Journeys) -> DataFrame:
    """Aligned users per step they matched, ``(step, event, users)``, with the users that started and
    completed on every row."""
    aligned = align(found, canonical_paths(found))
    done = F.sum(F.when(F.col("completed"), F.col("users")).otherwise(0))
    totals = {"started_users": F.sum("users").over(_whole()), "completed_users": done.over(_whole())}
    matched_events = F.slice("path", F.lit(1), F.greatest(F.col("matched"), F.lit(0)))
    return aligned.withColumns(totals).select("users", *totals, F.posexplode_outer(matched_events).alias("step", "event"))


def _nodes(steps: DataFrame) -> DataFrame:
    reached = steps.filter(F.col("step").isNotNull())
    nodes = reached.groupBy("step", "event").agg(F.sum("users").alias("users"), F.first("started_users").alias("started"))
    return nodes.select("step", "event", "users", share("users", "started").alias("pct_of_start")).orderBy(
        "step", F.desc("users"), "event"
    )


def _summary(steps: DataFrame) -> DataFrame:
    steps = steps.groupBy("step").agg(
        F.sum("users").alias("users"),
        F.array_join(F.sort_array(F.collect_set("event")), "/").alias("events"),
        F.first("started_users").alias("started_users"),
        F.first("completed_users").alias("completed_users"),
    )
    lost = F.col("users") - F.lead("users").over(_whole().orderBy("step"))
    lossy = F.col("lost_users").isNotNull()
    return (
        steps.withColumn("lost_users", lost)
        .orderBy(F.desc_nulls_last("lost_users"), "step")
        .limit(1)
        .select(
            "started_users",
            "completed_users",
            share("completed_users", "started_users").alias("completion"),
            F.when(lossy, F.col("step") + 1).alias("worst_step"),
            F.when(lossy, F.col("events")).alias("worst_events"),
            "lost_users",
        )
    )


def journey_views(
    log: DataFrame, start_event: str, end_event: str, *, segment: DataFrame | None = None, **options: Any
) -> dict[str, DataFrame]:
    """``nodes``, ``paths`` and ``summary`` of one journey map, from one pass over the log that is written.

    Options: ``timeframe_days``, ``as_of``, ``skew``.
    """
    found = _find(log, start_event, end_event, segment, options)
    steps = materialise(_aligned_steps(found), "aligned-steps")
    return {"nodes": _nodes(steps), "paths": canonical_paths(found).select("path", "users"), "summary": _summary(steps)}


def journey_map(log: DataFrame, start_event: str, end_event: str, **options: Any) -> DataFrame:
    """Nodes ``(step, event, users, pct_of_start)`` along the canonical paths.

    Options: ``segment``, ``timeframe_days``, ``as_of``, ``skew``.
    """
    return _nodes(_aligned_steps(_find(log, start_event, end_event, options.pop("segment", None), options)))


def journey_paths(log: DataFrame, start_event: str, end_event: str, **options: Any) -> DataFrame:
    """The canonical paths of a journey map as ``(path, users)``."""
    return canonical_paths(_find(log, start_event, end_event, options.pop("segment", None), options)).select("path", "users")


def journey_summary(log: DataFrame, start_event: str, end_event: str, **options: Any) -> DataFrame:
    """One row: users that started and completed, and the step after which most users are lost.

    No row if nobody started.
    """
    return _summary(_aligned_steps(_find(log, start_event, end_event, options.pop("segment", None), options)))
