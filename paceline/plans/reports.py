"""The three ready-made reports.

Each reads the log twice: a survey, and a pass that leaves the rows of its look-backs by user. All sections are cut from these.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.args import as_int, event_names, funnel_steps
from paceline.operators.breakdown import breakdown_entries, top_entries
from paceline.operators.compare import compare_discoveries, compare_profiles
from paceline.operators.funnel import export_funnel_segments, funnel_reach, funnel_steps_table
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy, survey
from paceline.operators.lookback import within
from paceline.operators.metrics import weekly_users
from paceline.operators.paths import journey_map, product_paths
from paceline.operators.segments import define_segment, discover_events, discover_together, profile_together
from paceline.session import materialise, materialise_by
from paceline.sources.segments import SegmentStore


def _lines(frame: DataFrame, section: str, item: Column, *values: str) -> DataFrame:
    """Rows of a report: section, item and up to three numbers."""
    numbers = [F.col(v).cast("double") for v in values]
    numbers += [F.lit(None).cast("double")] * (3 - len(numbers))
    return frame.select(
        F.lit(section).alias("section"), item.alias("item"), *[n.alias(f"value_{i}") for i, n in enumerate(numbers, 1)]
    )


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def _by_user(log: DataFrame, days: Sequence[Any], as_of: datetime | str | None, skew: SkewPolicy, events: Sequence[str] | None = None) -> DataFrame:
    """The rows of the longest look-back of a report, from one pass over the log, as a log of its own that all sections read.

    It lies in buckets by user, so that whatever is grouped by user needs no further exchange; if there are heavy users, as it comes.
    """
    rows = within(log, max(as_int(d, 90) for d in days), as_of)
    if events is not None:
        rows = rows.filter(F.col("event").isin(sorted(set(events))))
    return materialise_by(rows, "user_id", "report-rows") if skew.nobody else materialise(rows, "report-rows")


def conversion_blockers(
    log: DataFrame,
    users: DataFrame,
    store: SegmentStore,
    steps: str | Sequence[str],
    properties: Sequence[str],
    *,
    stalled_at_step: Any,
    base_name: str,
    timeframe_days: Any = 90,
    conversion_window_days: Any = 14,
    discovery_days: Any = 90,
    top_n: Any = 12,
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Why do users stall? The funnel, then stalled against converted users, by events and by profile.

    Sections ``funnel`` (users, conversion, loss), ``event`` and ``profile`` (stalled share, converted
    share, difference). Writes the reach once and the two segments cut from it.
    """
    names = funnel_steps(steps)
    as_of, skew = survey(log, as_of, skew)
    log = _by_user(log, [timeframe_days, discovery_days], as_of, skew)
    reach = funnel_reach(
        log, users, names, timeframe_days=timeframe_days, conversion_window_days=conversion_window_days,
        properties=properties, as_of=as_of, skew=skew,
    )
    reach = materialise(reach, "reach")
    stalled_name, converted_name = export_funnel_segments(
        store, reach, names, base_name=base_name, stalled_at_step=stalled_at_step, converted=True
    )
    stalled, converted = store.read(stalled_name), store.read(converted_name)
    cohorts = [stalled, converted]
    found = discover_together(log, users, cohorts, top_n=top_n, timeframe_days=discovery_days, as_of=as_of)
    profiles = profile_together(users, cohorts, properties)
    label = F.concat_ws("=", "property", "value")
    return _stack([
        _lines(
            funnel_steps_table(reach, names), "funnel", F.concat_ws(" ", F.col("step").cast("string"), "event"),
            "users", "conversion_from_start", "lost_from_previous",
        ),
        _lines(compare_discoveries(*found), "event", F.col("event"), "a_pct", "b_pct", "delta"),
        _lines(compare_profiles(*profiles), "profile", label, "a_pct", "b_pct", "delta"),
    ])


def upgrade_paths(
    log: DataFrame,
    users: DataFrame,
    store: SegmentStore,
    *,
    goal: str,
    path_start: str,
    journey_start: str,
    segment_name: str,
    timeframe_days: Any = 90,
    paths_days: int = 90,
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """How do users get to the goal? Recent doers, their distinctive events, the paths made of these
    events, and the journey map.

    Sections ``event`` (segment share, population share, lift), ``path`` (users, all completed users)
    and ``journey`` (users, share of start). The event set reaches the paths as a semi-join.
    """
    as_of, skew = survey(log, as_of, skew)
    log = _by_user(log, [timeframe_days, paths_days], as_of, skew)
    rule = {"event": goal, "op": "at_least", "count": 1, "timeframe_days": timeframe_days}
    store.write(segment_name, define_segment(log, users, event_filters=[rule], as_of=as_of))
    doers = store.read(segment_name)
    # Materialised, at most 12 rows: it is a result of its own and the filter of the paths.
    distinctive = materialise(
        discover_events(log, users, doers, top_n=12, timeframe_days=paths_days, as_of=as_of), "distinctive"
    )
    shared = {"timeframe_days": paths_days, "as_of": as_of, "skew": skew}
    paths = product_paths(log, path_start, goal, allowed_events=distinctive, top_n=8, **shared)
    nodes = journey_map(log, journey_start, goal, **shared)
    return _stack([
        _lines(distinctive, "event", F.col("event"), "segment_pct", "population_pct", "lift"),
        _lines(paths, "path", F.col("path"), "users", "completed_users"),
        _lines(
            nodes, "journey", F.concat_ws(" ", (F.col("step") + 1).cast("string"), "event"), "users", "pct_of_start"
        ),
    ])


def weekly_health(
    log: DataFrame,
    users: DataFrame,
    properties: Sequence[str],
    *,
    signup_events: str | Sequence[str],
    engagement_events: str | Sequence[str],
    steps: str | Sequence[str],
    series_days: Any = 56,
    funnel_days: Any = 28,
    conversion_window_days: Any = 14,
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Weekly users of two event sets, the funnel, and what helps or hinders its first two steps.

    Sections ``signups`` and ``engagement`` (users per week), ``funnel`` (users, conversion, loss),
    ``booster`` and ``blocker`` (affected users, lift, impact).
    """
    names = funnel_steps(steps)
    as_of, skew = survey(log, as_of, skew)
    options = {
        "timeframe_days": funnel_days, "conversion_window_days": conversion_window_days,
        "properties": properties, "as_of": as_of, "skew": skew,
    }
    parts = []
    sets = {"signups": signup_events, "engagement": engagement_events}
    wanted = [*names, *(e for listed in sets.values() for e in event_names(listed, "events", 1, 20))]
    log = _by_user(log, [series_days, funnel_days], as_of, skew, wanted)
    series = materialise(weekly_users(log, sets, timeframe_days=series_days, as_of=as_of), "weekly-users")
    for section in sets:
        own = series.filter(F.col(section) > 0)
        parts.append(_lines(own, section, F.col("week").cast("string"), section))
    # The breakdown's two-step reach is the full reach cut off at step 2.
    reach = materialise(funnel_reach(log, users, names, **options), "reach")
    parts.append(
        _lines(
            funnel_steps_table(reach, names), "funnel", F.concat_ws(" ", F.col("step").cast("string"), "event"),
            "users", "conversion_from_start", "lost_from_previous",
        )
    )
    entries = top_entries(breakdown_entries(reach, users, names[:2], properties))
    label = F.concat_ws("=", "property", "value")
    for kind in ("booster", "blocker"):
        side = entries.filter(F.col("kind") == kind)
        parts.append(_lines(side, kind, label, "affected_users", "lift", "impact"))
    return _stack(parts)
