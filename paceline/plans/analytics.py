"""All analyses over one log and one profile table, with plain arguments.

Numbers may be given as text and event lists as comma-separated text, as saved reports do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.args import as_flag, required_text
from paceline.operators.breakdown import breakdown_entries, breakdown_summary, top_entries
from paceline.operators.compare import compare_discoveries, compare_profiles, highlights
from paceline.operators.drilldown import drilldown_report, drilldown_tree
from paceline.operators.funnel import (
    export_funnel_segments,
    funnel_by_property,
    funnel_reach,
    funnel_steps_table,
    funnel_summary,
)
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy
from paceline.operators.metrics import insight, insight_summary
from paceline.operators.paths import journey_views, product_paths, product_paths_summary
from paceline.operators.segments import (
    define_segment,
    discover_events,
    discover_together,
    discovery_summary,
    profile_segment,
    profile_summary,
    profile_together,
)
from paceline.session import materialise
from paceline.sources.segments import SegmentStore
from paceline.sources.tables import event_catalog, property_values

Result = dict[str, DataFrame]


@dataclass(frozen=True)
class Analytics:
    """The analyses return named DataFrames; segments are exchanged by name through the store."""

    log: DataFrame
    users: DataFrame
    properties: Sequence[str]
    store: SegmentStore
    as_of: datetime | None = None
    skew: SkewPolicy = DEFAULT_SKEW

    def _segment(self, name: str) -> DataFrame:
        return self.store.read(required_text(name, "a segment name"))

    def catalog(self) -> Result:
        """Event names with their counts, and the values of each property."""
        return {"events": event_catalog(self.log), "property_values": property_values(self.users, self.properties)}

    def funnel_analysis(
        self,
        steps: str | Sequence[str],
        timeframe_days: Any = 90,
        conversion_window_days: Any = 14,
        filters: Mapping[str, Any] | None = None,
        breakdown_property: str | None = None,
        export_stalled_at_step: Any = None,
        export_converted: Any = False,
        segment_name: str = "",
    ) -> Result:
        """``steps``, ``summary`` and, if asked for, ``breakdown``; exports write segments at once. Writes the reach."""
        reach = funnel_reach(
            self.log,
            self.users,
            steps,
            timeframe_days=timeframe_days,
            conversion_window_days=conversion_window_days,
            filters=filters,
            properties=self.properties,
            as_of=self.as_of,
            skew=self.skew,
        )
        exports = export_stalled_at_step not in (None, "") or as_flag(export_converted)
        if exports:
            required_text(segment_name, "a segment base name")
        reach = materialise(reach, "reach")  # every table below is cut from it
        if exports:
            export_funnel_segments(
                self.store,
                reach,
                steps,
                base_name=segment_name,
                stalled_at_step=export_stalled_at_step,
                converted=export_converted,
            )
        result = {"steps": funnel_steps_table(reach, steps), "summary": funnel_summary(reach, steps)}
        if breakdown_property:
            result["breakdown"] = funnel_by_property(reach, self.users, steps, breakdown_property, self.properties)
        return result

    def insight_query(
        self,
        events: str | Sequence[str],
        metric: str = "unique_users",
        group_by_property: str | None = None,
        by_week: Any = False,
        timeframe_days: Any = 90,
        filters: Mapping[str, Any] | None = None,
    ) -> Result:
        """``rows`` as asked for, the ungrouped ``total``, and both in a ``summary`` row."""
        shared = {
            "events": events,
            "metric": metric,
            "timeframe_days": timeframe_days,
            "filters": filters,
            "properties": self.properties,
            "as_of": self.as_of,
        }
        rows = materialise(insight(self.log, self.users, group_by=group_by_property, by_week=by_week, **shared), "insight")
        total = materialise(insight(self.log, self.users, **shared), "insight")
        return {"rows": rows, "total": total, "summary": insight_summary(rows, total)}

    def segment_definition(
        self,
        name: str,
        filters: Mapping[str, Any] | None = None,
        event_filters: Sequence[Mapping[str, Any]] = (),
    ) -> Result:
        """Writes the segment; ``members`` reads it back, ``size`` is a row with its users."""
        name = required_text(name, "a segment name")
        members = define_segment(
            self.log,
            self.users,
            filters=filters,
            event_filters=event_filters,
            properties=self.properties,
            as_of=self.as_of,
        )
        self.store.write(name, members)
        return {
            "members": self.store.table().filter(F.col("segment_name") == name).select("user_id"),
            "size": self.store.sizes().filter(F.col("segment_name") == name),
        }

    def segment_event_discovery(self, segment: str, top_n: Any = 15, timeframe_days: Any = 90) -> Result:
        members = self._segment(segment)
        rows = discover_events(self.log, self.users, members, top_n=top_n, timeframe_days=timeframe_days, as_of=self.as_of)
        rows = materialise(rows, "discovery")
        size = members.agg(F.count_distinct("user_id").alias("segment_size"))
        return {"rows": rows, "summary": size.join(discovery_summary(rows), F.lit(True), "left")}

    def profile_segment(self, segment: str, min_relative_change: Any = 0.3) -> Result:
        members = self._segment(segment)
        deviations = profile_segment(self.users, members, self.properties, min_relative_change=min_relative_change)
        deviations = materialise(deviations, "deviations")
        return {"deviations": deviations, "summary": profile_summary(deviations, members)}

    def compare_segments(self, a: str, b: str, top_n: Any = 15, timeframe_days: Any = 90, min_relative_change: Any = 0.3) -> Result:
        """``events`` and ``profiles`` that differ between two segments, each with its ``highlights``."""
        cohorts = [self._segment(a), self._segment(b)]
        events = compare_discoveries(
            *discover_together(self.log, self.users, cohorts, top_n=top_n, timeframe_days=timeframe_days, as_of=self.as_of)
        )
        profiles = compare_profiles(
            *profile_together(self.users, cohorts, self.properties, min_relative_change=min_relative_change)
        )
        events, profiles = materialise(events, "comparison"), materialise(profiles, "comparison")
        return {
            "events": events, "profiles": profiles,
            "event_highlights": highlights(events, a, b), "profile_highlights": highlights(profiles, a, b),
        }

    def product_paths(
        self,
        start_event: str,
        end_event: str,
        allowed_events: str | Sequence[str] | DataFrame | None = None,
        top_n: Any = 10,
        timeframe_days: Any = 90,
    ) -> Result:
        paths = product_paths(
            self.log, start_event, end_event, allowed_events=allowed_events, top_n=top_n, timeframe_days=timeframe_days,
            as_of=self.as_of, skew=self.skew,
        )
        paths = materialise(paths, "paths")
        return {"paths": paths.filter(F.col("path").isNotNull()), "summary": product_paths_summary(paths)}

    def journey_map(
        self, start_event: str, end_event: str, segment: str | None = None, timeframe_days: Any = 90
    ) -> Result:
        """``nodes``, ``paths`` and ``summary``: three views of journeys that are written once."""
        options = {
            "segment": self._segment(segment) if segment else None,
            "timeframe_days": timeframe_days,
            "as_of": self.as_of,
            "skew": self.skew,
        }
        return journey_views(self.log, start_event, end_event, **options)

    def funnel_breakdown(
        self,
        steps: str | Sequence[str],
        timeframe_days: Any = 90,
        conversion_window_days: Any = 14,
        filters: Mapping[str, Any] | None = None,
        max_values_per_property: Any = 8,
    ) -> Result:
        """``entries`` of all candidate values, ``top`` with the five strongest of either side, and a ``summary`` with the base."""
        reach = funnel_reach(
            self.log,
            self.users,
            steps,
            timeframe_days=timeframe_days,
            conversion_window_days=conversion_window_days,
            filters=filters,
            properties=self.properties,
            as_of=self.as_of,
            skew=self.skew,
        )
        reach = materialise(reach, "reach")
        entries = breakdown_entries(
            reach, self.users, steps, self.properties, filters=filters, max_values_per_property=max_values_per_property
        )
        entries = materialise(entries, "entries")
        return {"entries": entries, "top": top_entries(entries), "summary": breakdown_summary(reach, steps, entries)}

    def drilldown(
        self,
        steps: str | Sequence[str],
        timeframe_days: Any = 90,
        max_depth: Any = 3,
        conversion_window_days: Any = 14,
    ) -> Result:
        """Runs the search level by level; ``tree`` and ``report`` read what it wrote."""
        tree = drilldown_tree(
            self.log,
            self.users,
            steps,
            self.properties,
            max_depth=max_depth,
            timeframe_days=timeframe_days,
            conversion_window_days=conversion_window_days,
            as_of=self.as_of,
            skew=self.skew,
        )
        return {"tree": tree, "report": drilldown_report(tree, steps)}
