"""Recursive search for the cohorts in which a funnel loses its users.

Users are reduced to counts per combination of property values, reach and step pairs. One aggregation over grouping sets, a set
for each choice of properties up to the depth of the search, then holds the figures of every cohort that any path could lead to; what
a cohort's blockers are, which of them become cohorts of their own, and the tree, is picked from these rows. Work grows with the
number of combinations times that of the grouping sets, which is small for a handful of properties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.args import as_int, funnel_steps, known_property
from paceline.functions.numeric import round_exact, share
from paceline.operators.breakdown import LEAST_USERS, score_values
from paceline.operators.funnel import funnel_reach, step_counts, step_rows, worst_loss
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy
from paceline.session import materialise

# Fixed values of the analysis.
LEAST_COHORT = 200
LEAST_LOST_FRACTION = 0.10
BLOCKERS_PER_NODE = 3
BREAKDOWN_VALUES = 8

ROOT = "{}"
FILTERS = "array<struct<key: string, value: string>>"
BLOCKERS = "array<struct<impact: double, property: string, value: string, lift: double, conversion: double, affected_users: bigint>>"
FRONTIER = (
    "signature string, parent string, depth int, filters map<string,string>, path array<string>, sort_key array<string>"
)


def cohort_base(
    log: DataFrame,
    users: DataFrame,
    steps: str | Sequence[str],
    properties: Sequence[str],
    *,
    timeframe_days: Any = 90,
    conversion_window_days: Any = 14,
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Users per combination of property values, funnel reach and reach of each step pair.

    Reach does not depend on the cohort, so the log is read once; every cohort's funnel and
    breakdown is a sum over these rows.
    """
    names = funnel_steps(steps)
    reach = funnel_reach(
        log,
        users,
        names,
        timeframe_days=timeframe_days,
        conversion_window_days=conversion_window_days,
        properties=properties,
        as_of=as_of,
        skew=skew,
        with_pairs=True,
    )
    pairs = [f"pair_{k}" for k in range(1, len(names))]
    profiles = users.select("user_id", *[F.col(p).cast("string").alias(p) for p in properties])
    return reach.join(profiles, "user_id").groupBy(*properties, "reached", *pairs).agg(F.count(F.lit(1)).alias("n"))


def _signature(entries: str | Column) -> Column:
    """Canonical text of sorted filters: JSON with sorted keys."""
    return F.to_json(F.map_from_entries(entries))


def cohort_figures(base: DataFrame, properties: Sequence[str], subsets: Sequence[Sequence[str]], figures: Sequence[Column]) -> DataFrame:
    """``signature``, ``filters`` (an array of (key, value), sorted) and the figures of every cohort that filters on one of the sets
    of properties. One aggregation over grouping sets; a missing value equals nothing, so it makes no cohort.
    """
    names = sorted({p for subset in subsets for p in subset})
    if not names:
        whole = base.agg(*figures)
        return whole.select(F.lit(ROOT).alias("signature"), F.array().cast(FILTERS).alias("filters"), *whole.columns)
    grouped = base.groupingSets([[F.col(p) for p in subset] for subset in subsets], *names).agg(F.grouping_id().alias("left_out"), *figures)
    chosen = {p: F.col("left_out").bitwiseAND(F.lit(1 << (len(names) - 1 - k))) == 0 for k, p in enumerate(names)}
    missing = F.lit(False)
    for p, taken in chosen.items():
        missing = missing | (taken & F.col(p).isNull())
    entries = F.array_compact(F.array(*[F.when(taken, F.struct(F.lit(p).alias("key"), F.col(p).alias("value"))) for p, taken in chosen.items()]))
    kept = [c for c in grouped.columns if c not in (*names, "left_out")]
    return grouped.filter(~missing).select(entries.cast(FILTERS).alias("filters"), *kept).select(_signature("filters").alias("signature"), "filters", *kept)


def _with_zeros(frontier: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``at_1 .. at_n`` of every cohort of the frontier; cohorts without users have zeros."""
    zeros = {f"at_{k}": F.coalesce(f"at_{k}", F.lit(0).cast("long")) for k in range(1, n + 1)}
    return frontier.join(counts, "signature", "left").withColumns(zeros)


def cohort_funnels(
    base: DataFrame, steps: str | Sequence[str], cohorts: Sequence[Mapping[str, Any]], properties: Sequence[str]
) -> DataFrame:
    """The step tables of many cohorts, each given by its filters, from one pass over the base."""
    names = funnel_steps(steps)
    listed = []
    for filters in cohorts:
        for prop in filters:
            known_property(prop, properties)
        listed.append(({p: str(v) for p, v in filters.items()},))
    frontier = base.sparkSession.createDataFrame(listed, "filters map<string,string>")
    frontier = frontier.select(_signature(F.array_sort(F.map_entries("filters"))).alias("signature")).distinct()
    subsets = sorted({tuple(sorted(f)) for (f,) in listed})
    counts = cohort_figures(base, properties, subsets, step_counts(len(names), F.col("n"))).drop("filters")
    return step_rows(_with_zeros(frontier, counts, len(names)), names, ["signature"])


def _blockers(cohorts: DataFrame) -> DataFrame:
    """``(signature, blockers)``: what hinders the worst step pair of each cohort that may be expanded.

    A cohort with one filter more is a value of the cohort without that filter, for each of its filters.
    """
    parent = F.filter("filters", lambda x: x["key"] != F.col("own.key"))
    values = cohorts.select("filters", F.explode("filters").alias("own"), "starts", "ends").select(
        _signature(parent).alias("signature"), F.col("own.key").alias("property"), F.col("own.value").alias("value"), "starts", "ends"
    )
    pair = F.col("worst.step") - 1
    open_nodes = cohorts.filter((F.col("at_1") > 0) & (F.col("worst.lost") >= LEAST_COHORT)).select(
        "signature", pair.alias("pair"), F.get("starts", pair).alias("base_users"), share("get(ends, worst.step - 1)", "get(starts, worst.step - 1)").alias("base_conversion")
    )
    counted = values.join(open_nodes, "signature").withColumns({"start_users": F.get("starts", F.col("pair")), "end_users": F.get("ends", F.col("pair"))})
    # At most 8 values of each property are left per cohort.
    worse = score_values(counted, ["signature"], BREAKDOWN_VALUES).filter(F.col("lift") < 0)
    row = F.struct((-F.col("impact")).alias("order"), "property", "value", "lift", "conversion", "affected_users")
    strongest = F.slice(F.sort_array(F.collect_list(row)), 1, BLOCKERS_PER_NODE)
    blocker = F.transform(
        strongest,
        lambda b: F.struct(
            (-b["order"]).alias("impact"),
            *[b[c].alias(c) for c in ("property", "value", "lift", "conversion", "affected_users")],
        ),
    )
    return worse.groupBy("signature").agg(blocker.alias("blockers"))


def all_cohorts(base: DataFrame, steps: list[str], properties: Sequence[str], deepest: int) -> DataFrame:
    """``signature, at_1 .. at_n, worst, blockers`` of every cohort of up to ``deepest`` filters that can be a node or a value of
    one; those of ``deepest`` filters are not expanded, so have no blockers."""
    n = len(steps)
    pairs = [F.col(f"pair_{k}") for k in range(1, n)]
    reached = [[F.sum(F.when(p >= k, F.col("n")).otherwise(0)) for p in pairs] for k in (1, 2)]
    figures = [*step_counts(n, F.col("n")), F.array(*reached[0]).alias("starts"), F.array(*reached[1]).alias("ends")]
    subsets = [c for size in range(min(deepest, len(properties)) + 1) for c in combinations(sorted(properties), size)]
    found = cohort_figures(base, properties, subsets, figures).withColumn("worst", worst_loss(n))
    # A value of fewer users is no candidate at any step pair.
    cohorts = materialise(found.filter((F.size("filters") == 0) | (F.array_max("starts") >= LEAST_USERS)), "cohort-figures")
    if deepest == 0:
        return cohorts.withColumn("blockers", F.lit(None).cast(BLOCKERS))
    open_ones = cohorts.join(_blockers(cohorts), "signature", "left")
    return open_ones.withColumn("blockers", F.when(F.size("filters") < deepest, F.col("blockers")))


def _children(nodes: DataFrame) -> DataFrame:
    """The next frontier: big enough blockers of the expanded nodes, one row per cohort.

    Cohorts of different levels differ in their number of filters, so only cohorts proposed twice
    in one level have to be merged; the smallest parent signature is kept.
    """
    least = F.greatest(F.lit(LEAST_COHORT), F.floor(F.col("worst.lost") * F.lit(LEAST_LOST_FRACTION)))
    blocker = F.col("blocker")
    proposals = (
        nodes.filter(F.col("blockers").isNotNull())
        .withColumn("blocker", F.explode("blockers"))
        .filter(blocker["affected_users"] >= least)
        .withColumn("child", F.map_concat("filters", F.create_map(blocker["property"], blocker["value"])))
        .withColumn("key", _signature(F.array_sort(F.map_entries("child"))))
    )
    step = F.concat_ws("=", blocker["property"], blocker["value"])
    row = F.struct(
        F.col("key").alias("signature"),
        F.col("signature").alias("parent"),
        (F.col("depth") + 1).alias("depth"),
        F.col("child").alias("filters"),
        F.concat("path", F.array(step)).alias("path"),
        F.concat("sort_key", F.array("key")).alias("sort_key"),
    )
    return proposals.groupBy("key").agg(F.min_by(row, "signature").alias("row")).select("row.*")


def drilldown_tree(
    log: DataFrame,
    users: DataFrame,
    steps: str | Sequence[str],
    properties: Sequence[str],
    *,
    max_depth: Any = 3,
    **options: Any,
) -> DataFrame:
    """All nodes of the tree: ``signature, parent, depth, filters, path, sort_key, at_1 .. at_n,
    worst (lost, step), blockers``.

    The figures of all cohorts are written; the levels of the tree are then joined to them, level to level, in one plan.
    Options: ``timeframe_days``, ``conversion_window_days``, ``as_of``, ``skew``.
    """
    names = funnel_steps(steps)
    deepest = max(as_int(max_depth, 3), 0)
    base = cohort_base(log, users, names, properties, **options)
    known = materialise(all_cohorts(base, names, properties, deepest).drop("filters", "starts", "ends"), "cohorts")
    spark = base.sparkSession
    frontier = spark.createDataFrame([(ROOT, "", 0, {}, [], [ROOT])], FRONTIER)
    # The root is there without users too; its worst step is that of zeros.
    tree = level = _with_zeros(frontier, known, len(names)).withColumn("worst", worst_loss(len(names)))
    for _ in range(min(deepest, len(properties))):
        level = _children(level).join(known, "signature")
        tree = tree.unionByName(level)
    return tree


def drilldown_report(tree: DataFrame, steps: str | Sequence[str]) -> DataFrame:
    """One line per node, depth first: label, users, conversion, worst step and blockers."""
    names = funnel_steps(steps)
    labels = F.array(*[F.lit(s) for s in names])
    started = F.col("at_1") > 0
    step = F.col("worst.step")
    blocker_text = F.transform(
        "blockers",
        lambda b: F.concat(
            b["property"],
            F.lit("="),
            b["value"],
            F.lit(" (lift "),
            b["lift"].cast("decimal(6,4)").cast("string"),
            F.lit(", "),
            b["affected_users"].cast("string"),
            F.lit(" users)"),
        ),
    )
    return tree.select(
        # As many rows as the tree has nodes.
        F.row_number().over(Window.orderBy("sort_key")).alias("line"),
        "depth",
        F.when(F.size("path") == 0, "all users").otherwise(F.array_join("path", ", ")).alias("cohort"),
        F.col("at_1").alias("users"),
        F.coalesce(round_exact(f"at_{len(names)} / nullif(at_1, 0) * 100", 1), F.lit(0.0)).alias("conversion_pct"),
        F.when(started, F.get(labels, step - 1)).alias("worst_from"),
        F.when(started, F.get(labels, step)).alias("worst_to"),
        F.when(started, F.col("worst.lost")).alias("lost_users"),
        F.coalesce(F.array_join(blocker_text, "; "), F.lit("")).alias("blockers"),
    ).orderBy("line")
