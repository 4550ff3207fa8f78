"""One entry per operator: name -> function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.numeric import share
from paceline.operators.breakdown import breakdown_entries, breakdown_summary, top_entries
from paceline.operators.compare import compare_discoveries, compare_profiles, highlights
from paceline.operators.conform import conformed_event_log, name_conformance, property_conformance
from paceline.operators.drilldown import cohort_base, cohort_funnels, drilldown_report, drilldown_tree
from paceline.operators.funnel import (
    converted_users,
    export_funnel_segments,
    funnel_by_property,
    funnel_reach,
    funnel_steps_table,
    funnel_summary,
    stalled_users,
)
from paceline.operators.lookback import within
from paceline.operators.metrics import insight, insight_summary
from paceline.operators.paths import (
    canonical_paths,
    journey_map,
    journey_paths,
    journey_summary,
    product_paths,
    product_paths_summary,
)
from paceline.operators.segments import define_segment, discover_events, discovery_summary, profile_segment, profile_summary
from paceline.operators.sequences import (
    ARROW,
    compressed_sequences,
    journey_sequences,
    journeys,
    path_windows,
    scoped_rows,
    user_sequences,
)
from paceline.plans.reports import conversion_blockers, upgrade_paths, weekly_health
from paceline.session import materialise
from paceline.sources.tables import event_catalog, property_values
from workload.inputs import (
    PROPERTIES,
    click_log,
    click_states,
    click_log_by_day,
    click_log_ordered,
    customer_profiles,
    fresh_store,
    misspelt_words,
    noisy_click_log,
    noisy_profile_values,
    order_log,
    word_dictionary,
)

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL in oracles.py.
ORDER_STEPS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ORDER_FUNNEL = {"timeframe_days": 2500, "conversion_window_days": 365}
CLICK_STEPS = ["signup", "click", "purchase"]
ORDER_ENDS = ("1-URGENT", "5-LOW")
CLICK_ENDS = ("signup", "purchase")
DAYS_C, DAYS_O = 30, 2500

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _order_reach(spark: SparkSession, sf: str, **options) -> DataFrame:
    return funnel_reach(
        order_log(spark, sf), customer_profiles(spark, sf), ORDER_STEPS, properties=PROPERTIES,
        **{**ORDER_FUNNEL, **options},
    )


def _order_segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stalled and converted users of the order funnel, exported and read back."""
    store = fresh_store(spark)
    reach = materialise(_order_reach(spark, sf), "reach")
    names = export_funnel_segments(store, reach, ORDER_STEPS, base_name="orders", stalled_at_step=1, converted=True)
    return store.read(names[0]), store.read(names[1])


# ------------------------------------------------------------------ sources


@_query
def event_log(spark, sf):
    return order_log(spark, sf)


@_query
def click_event_log(spark, sf):
    return click_log(spark, sf)


@_query
def user_profiles(spark, sf):
    return customer_profiles(spark, sf)


@_query
def event_catalog_clicks(spark, sf):
    return event_catalog(click_log(spark, sf))


@_query
def event_catalog_orders(spark, sf):
    return event_catalog(order_log(spark, sf))


@_query
def property_value_dictionary(spark, sf):
    return property_values(customer_profiles(spark, sf), PROPERTIES)


@_query
def anchored_lookback(spark, sf):
    return within(click_log(spark, sf), 10)


@_query
def lookback_by_day(spark, sf):
    return within(click_log_by_day(spark, sf), 10)


@_query
def lookback_ordered(spark, sf):
    return within(click_log_ordered(spark, sf), 10)


@_query
def funnel_by_day(spark, sf):
    return funnel_reach(click_log_by_day(spark, sf), customer_profiles(spark, sf), CLICK_STEPS, timeframe_days=10, conversion_window_days=3)


# ------------------------------------------------------------------ metrics


@_query
def insight_summary_weekly(spark, sf):
    shared = {"events": ["purchase", "click"], "timeframe_days": DAYS_C}
    return insight_summary(insight(click_log(spark, sf), by_week=True, **shared), insight(click_log(spark, sf), **shared))


@_query
def insight_unique_users(spark, sf):
    return insight(order_log(spark, sf), events=["1-URGENT", "2-HIGH"], timeframe_days=365)


@_query
def insight_event_count(spark, sf):
    return insight(click_log(spark, sf), events="click, purchase", metric="event_count", timeframe_days=14)


@_query
def insight_by_week(spark, sf):
    return insight(click_log(spark, sf), events=["purchase", "click"], by_week=True, timeframe_days=DAYS_C)


@_query
def insight_count_by_week(spark, sf):
    return insight(
        order_log(spark, sf), events=["5-LOW"], metric="event_count", by_week=True, timeframe_days=DAYS_O
    )


@_query
def insight_by_property(spark, sf):
    return insight(
        order_log(spark, sf), customer_profiles(spark, sf), events=["1-URGENT", "2-HIGH"], group_by="nation",
        timeframe_days=730, properties=PROPERTIES,
    )


@_query
def insight_count_by_property(spark, sf):
    return insight(
        click_log(spark, sf), customer_profiles(spark, sf), events=["view"], metric="event_count",
        group_by="balance_band", timeframe_days=DAYS_C, properties=PROPERTIES,
    )


@_query
def insight_filtered(spark, sf):
    return insight(
        order_log(spark, sf), customer_profiles(spark, sf), events=["1-URGENT", "5-LOW"], metric="event_count",
        timeframe_days=DAYS_O, filters={"region": "ASIA", "balance_band": "mid"}, properties=PROPERTIES,
    )


@_query
def insight_filtered_by_week(spark, sf):
    return insight(
        click_log(spark, sf), customer_profiles(spark, sf), events=["view", "click"], by_week=True,
        timeframe_days=DAYS_C, filters={"balance_band": "high"}, properties=PROPERTIES,
    )


@_query
def user_states_total(spark, sf):
    return click_states(spark, sf).insight(click_log(spark, sf), events="click, purchase", timeframe_days=14)


@_query
def user_states_by_week(spark, sf):
    return click_states(spark, sf).insight(click_log(spark, sf), events=["purchase", "click"], by_week=True, timeframe_days=DAYS_C)


@_query
def user_states_by_property(spark, sf):
    return click_states(spark, sf).insight(
        click_log(spark, sf), customer_profiles(spark, sf), events=["view"], group_by="nation", timeframe_days=DAYS_C,
        filters={"balance_band": "high"}, properties=PROPERTIES,
    )


# ------------------------------------------------------------------- funnel


@_query
def funnel_reach_orders(spark, sf):
    return _order_reach(spark, sf)


@_query
def funnel_reach_clicks(spark, sf):
    return funnel_reach(
        click_log(spark, sf), customer_profiles(spark, sf), CLICK_STEPS, timeframe_days=30, conversion_window_days=1
    )


@_query
def funnel_reach_repeated_step(spark, sf):
    return funnel_reach(
        click_log(spark, sf), customer_profiles(spark, sf), ["view", "view", "purchase"], timeframe_days=14,
        conversion_window_days=2,
    )


@_query
def funnel_steps(spark, sf):
    return funnel_steps_table(_order_reach(spark, sf), ORDER_STEPS)


@_query
def funnel_steps_filtered(spark, sf):
    return funnel_steps_table(
        _order_reach(spark, sf, filters={"segment": "BUILDING", "balance_band": "mid"}), ORDER_STEPS
    )


@_query
def funnel_by_property_nation(spark, sf):
    return funnel_by_property(_order_reach(spark, sf), customer_profiles(spark, sf), ORDER_STEPS, "nation", PROPERTIES)


@_query
def funnel_worst_step(spark, sf):
    return funnel_summary(_order_reach(spark, sf), ORDER_STEPS)


@_query
def segment_stalled(spark, sf):
    return stalled_users(_order_reach(spark, sf), ORDER_STEPS, 1)


@_query
def segment_converted(spark, sf):
    return converted_users(_order_reach(spark, sf), ORDER_STEPS)


# ----------------------------------------------------------------- segments


@_query
def segment_by_profile(spark, sf):
    return define_segment(
        order_log(spark, sf), customer_profiles(spark, sf), filters={"segment": "BUILDING", "region": "EUROPE"},
        properties=PROPERTIES,
    )


@_query
def segment_at_least(spark, sf):
    rule = {"event": "purchase", "op": "at_least", "count": 15, "timeframe_days": DAYS_C}
    return define_segment(click_log(spark, sf), customer_profiles(spark, sf), event_filters=[rule])


@_query
def segment_at_most(spark, sf):
    rule = {"event": "1-URGENT", "op": "at_most", "count": 1, "timeframe_days": DAYS_O}
    return define_segment(order_log(spark, sf), customer_profiles(spark, sf), event_filters=[rule])


@_query
def segment_chained(spark, sf):
    rules = [
        {"event": "1-URGENT", "op": "at_least", "count": 2, "timeframe_days": DAYS_O},
        {"event": "5-LOW", "op": "at_most", "count": 1, "timeframe_days": 1000},
        {"event": "2-HIGH", "count": 1, "timeframe_days": 2000},
    ]
    return define_segment(
        order_log(spark, sf), customer_profiles(spark, sf), filters={"balance_band": "mid"}, event_filters=rules,
        properties=PROPERTIES,
    )


@_query
def segment_store_sizes(spark, sf):
    store = fresh_store(spark)
    reach = materialise(_order_reach(spark, sf), "reach")
    for _ in range(2):  # the second export replaces the first
        export_funnel_segments(store, reach, ORDER_STEPS, base_name="orders", stalled_at_step=2, converted=True)
    rule = {"event": "1-URGENT", "op": "at_least", "count": 3, "timeframe_days": DAYS_O}
    store.write("007", define_segment(order_log(spark, sf), customer_profiles(spark, sf), event_filters=[rule]))
    return store.sizes()


@_query
def segment_store_names(spark, sf):
    """Segments of awkward names, one of them emptied again."""
    store, users = fresh_store(spark), customer_profiles(spark, sf)
    for name, region in (("z\u00fcrich", "EUROPE"), ("\u65e5\u672c", "ASIA"), ("a/b = 50%", "AFRICA"), ("gone", "AMERICA")):
        store.write(name, define_segment(users, users, filters={"region": region}, properties=PROPERTIES))
    store.write("gone", users.limit(0))
    return store.table()


@_query
def segment_event_discovery(spark, sf):
    stalled, _ = _order_segments(spark, sf)
    return discover_events(order_log(spark, sf), customer_profiles(spark, sf), stalled, timeframe_days=DAYS_O)


@_query
def discovery_summary_row(spark, sf):
    _, converted = _order_segments(spark, sf)
    return discovery_summary(
        discover_events(order_log(spark, sf), customer_profiles(spark, sf), converted, timeframe_days=DAYS_O)
    )


@_query
def profile_segment_converted(spark, sf):
    _, converted = _order_segments(spark, sf)
    return profile_segment(customer_profiles(spark, sf), converted, PROPERTIES)


@_query
def compare_discoveries_funnel(spark, sf):
    log, users = order_log(spark, sf), customer_profiles(spark, sf)
    a, b = (discover_events(log, users, s, top_n=4, timeframe_days=500) for s in _order_segments(spark, sf))
    return compare_discoveries(a, b)


@_query
def compare_profiles_funnel(spark, sf):
    a, b = (
        profile_segment(customer_profiles(spark, sf), s, PROPERTIES, min_relative_change=0.1)
        for s in _order_segments(spark, sf)
    )
    return compare_profiles(a, b)


@_query
def compare_highlights_funnel(spark, sf):
    return highlights(compare_profiles_funnel(spark, sf), "stalled", "converted")


@_query
def profile_summary_converted(spark, sf):
    _, converted = _order_segments(spark, sf)
    return profile_summary(profile_segment(customer_profiles(spark, sf), converted, PROPERTIES), converted)


# -------------------------------------------------------------------- paths


@_query
def product_paths_nowhere(spark, sf):
    """Nobody gets there: no path, but the number of users that did."""
    return product_paths(click_log(spark, sf), "signup", "refund", timeframe_days=DAYS_C)


@_query
def product_paths_summary_clicks(spark, sf):
    return product_paths_summary(product_paths(click_log(spark, sf), *CLICK_ENDS, timeframe_days=DAYS_C))


@_query
def user_sequences_orders(spark, sf):
    return user_sequences(scoped_rows(order_log(spark, sf), timeframe_days=1000))


@_query
def user_sequences_scoped(spark, sf):
    rule = {"event": "purchase", "op": "at_least", "count": 15, "timeframe_days": DAYS_C}
    log = click_log(spark, sf)
    buyers = define_segment(log, customer_profiles(spark, sf), event_filters=[rule])
    return user_sequences(scoped_rows(log, timeframe_days=10, allowed_events=["signup", "purchase"], segment=buyers))


@_query
def compressed_sequences_orders(spark, sf):
    return compressed_sequences(scoped_rows(order_log(spark, sf), timeframe_days=DAYS_O))


@_query
def path_windows_clicks(spark, sf):
    found = journeys(scoped_rows(click_log(spark, sf), timeframe_days=DAYS_C), *CLICK_ENDS)
    return path_windows(found).select("user_id", F.array_join("events", ARROW).alias("path"))


@_query
def product_paths_clicks(spark, sf):
    return product_paths(click_log(spark, sf), *CLICK_ENDS, timeframe_days=DAYS_C)


@_query
def product_paths_orders(spark, sf):
    return product_paths(
        order_log(spark, sf), *ORDER_ENDS, allowed_events=["2-HIGH", "3-MEDIUM"], timeframe_days=DAYS_O, top_n=8
    )


@_query
def journey_sequences_orders(spark, sf):
    return journey_sequences(journeys(scoped_rows(order_log(spark, sf), timeframe_days=DAYS_O), *ORDER_ENDS))


@_query
def journey_canonical_paths(spark, sf):
    return journey_paths(order_log(spark, sf), *ORDER_ENDS, timeframe_days=DAYS_O)


@_query
def journey_nodes(spark, sf):
    return journey_map(order_log(spark, sf), *ORDER_ENDS, timeframe_days=DAYS_O)


@_query
def journey_nodes_segment(spark, sf):
    log, users = order_log(spark, sf), customer_profiles(spark, sf)
    rule = {"event": "1-URGENT", "op": "at_least", "count": 3, "timeframe_days": DAYS_O}
    store = fresh_store(spark)
    store.write("urgent", define_segment(log, users, event_filters=[rule]))
    return journey_map(log, *ORDER_ENDS, segment=store.read("urgent"), timeframe_days=DAYS_O)


@_query
def journey_summary_row(spark, sf):
    return journey_summary(order_log(spark, sf), *ORDER_ENDS, timeframe_days=DAYS_O)


# ---------------------------------------------------- breakdown, drill-down


@_query
def breakdown_entries_orders(spark, sf):
    return breakdown_entries(_order_reach(spark, sf), customer_profiles(spark, sf), ORDER_STEPS, PROPERTIES)


@_query
def breakdown_top(spark, sf):
    entries = breakdown_entries(_order_reach(spark, sf), customer_profiles(spark, sf), ORDER_STEPS, PROPERTIES)
    return top_entries(entries)


@_query
def breakdown_summary_top(spark, sf):
    reach, users = materialise(_order_reach(spark, sf), "reach"), customer_profiles(spark, sf)
    return breakdown_summary(reach, ORDER_STEPS, breakdown_entries(reach, users, ORDER_STEPS, PROPERTIES))


@_query
def breakdown_summary_small(spark, sf):
    """A cohort in which no value has enough users: the base is there, no entry is."""
    filters = {"balance_band": "negative", "nation": "FRANCE"}
    reach, users = materialise(_order_reach(spark, sf, filters=filters), "reach"), customer_profiles(spark, sf)
    entries = breakdown_entries(reach, users, ORDER_STEPS, PROPERTIES, filters=filters)
    return breakdown_summary(reach, ORDER_STEPS, entries)


@_query
def breakdown_filtered(spark, sf):
    filters = {"balance_band": "mid"}
    return breakdown_entries(
        _order_reach(spark, sf, filters=filters), customer_profiles(spark, sf), ORDER_STEPS, PROPERTIES,
        filters=filters, max_values_per_property=4,
    )


@_query
def cohort_funnels_orders(spark, sf):
    users = customer_profiles(spark, sf)
    base = cohort_base(order_log(spark, sf), users, ORDER_STEPS, PROPERTIES, **ORDER_FUNNEL)
    cohorts = [
        {},
        {"segment": "HOUSEHOLD"},
        {"region": "MIDDLE EAST"},
        {"segment": "AUTOMOBILE", "region": "ASIA"},
        {"segment": "AUTOMOBILE", "nation": "NOWHERE"},
    ]
    return cohort_funnels(base, ORDER_STEPS, cohorts, PROPERTIES)


def _tree(spark, sf):
    return drilldown_tree(
        order_log(spark, sf), customer_profiles(spark, sf), ORDER_STEPS, PROPERTIES, max_depth=3, **ORDER_FUNNEL
    )


@_query
def drilldown_tree_orders(spark, sf):
    return _tree(spark, sf).select(
        "signature",
        "parent",
        "depth",
        F.col("at_1").alias("started_users"),
        F.col("at_3").alias("converted_users"),
        share("at_3", "at_1").alias("conversion"),
        F.col("worst.step").alias("worst_step"),
        F.col("worst.lost").alias("lost_users"),
        F.coalesce(
            F.array_join(F.transform("blockers", lambda b: F.concat_ws("=", b["property"], b["value"])), "; "), F.lit("")
        ).alias("blockers"),
    )


@_query
def drilldown_report_orders(spark, sf):
    return drilldown_report(_tree(spark, sf), ORDER_STEPS)


# ---------------------------------------------------------- name conformance


@_query
def name_conformance_clicks(spark, sf):
    dictionary = event_catalog(click_log(spark, sf)).select("event")
    return name_conformance(noisy_click_log(spark, sf), dictionary)


@_query
def name_conformance_words(spark, sf):
    """No SQL: it would compare every word with the whole dictionary; ``tests/test_conform.py`` does so on a small one."""
    dictionary = materialise(word_dictionary(spark, sf), "word-dictionary")  # all texts are cut into words once
    return name_conformance(misspelt_words(spark, sf, dictionary), dictionary)


@_query
def conformed_event_log_clicks(spark, sf):
    dictionary = event_catalog(click_log(spark, sf)).select("event")
    return event_catalog(conformed_event_log(noisy_click_log(spark, sf), dictionary))


@_query
def property_conformance_profiles(spark, sf):
    values = property_values(customer_profiles(spark, sf), PROPERTIES)
    return property_conformance(noisy_profile_values(spark, sf), PROPERTIES, values)


# ------------------------------------------------------------------ reports


@_query
def conversion_blockers_report(spark, sf):
    return conversion_blockers(
        order_log(spark, sf), customer_profiles(spark, sf), fresh_store(spark), ORDER_STEPS, PROPERTIES,
        stalled_at_step=1, base_name="orders", discovery_days=DAYS_O, **ORDER_FUNNEL,
    )


@_query
def upgrade_paths_report(spark, sf):
    return upgrade_paths(
        order_log(spark, sf), customer_profiles(spark, sf), fresh_store(spark), goal="5-LOW", path_start="1-URGENT",
        journey_start="2-HIGH", segment_name="doers", timeframe_days=500, paths_days=DAYS_O,
    )


@_query
def weekly_health_report(spark, sf):
    return weekly_health(
        click_log(spark, sf), customer_profiles(spark, sf), PROPERTIES, signup_events=["signup"],
        engagement_events=["click", "view", "purchase"], steps=CLICK_STEPS, conversion_window_days=1,
    )
