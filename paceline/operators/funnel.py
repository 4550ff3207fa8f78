"""Ordered conversion funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.args import as_flag, as_int, funnel_steps, known_property, profile_condition, required_text
from paceline.functions.numeric import missing_share, share
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy, composed
from paceline.operators.lookback import surveyed, within
from paceline.session import materialise
from paceline.sources.segments import SegmentStore

TOP_VALUES = 8


def _at(event: str) -> Column:
    return F.when(F.col("event") == event, F.col("ts"))


def _passed(n: int) -> Column:
    """How many of the chained step times ``t1 .. tn`` are present."""
    return F.expr(" + ".join(f"if(t{k} IS NULL, 0, 1)" for k in range(1, n + 1)))


def _light_reach(rows: DataFrame, steps: list[str], window_days: int, pairs: bool) -> DataFrame:
    """Users whose step events fit into one task: one shuffle, then array minima."""
    n = len(steps)
    per_user = rows.groupBy("user_id").agg(
        F.min(_at(steps[0])).alias("t1"),
        *[F.collect_list(_at(steps[k - 1])).alias(f"all{k}") for k in range(2, n + 1)],
    )
    if not pairs:
        per_user = per_user.filter(F.col("t1").isNotNull())
    span = f"make_dt_interval({window_days})"
    if pairs and n > 2:
        per_user = per_user.withColumns({f"first{k}": F.array_min(f"all{k}") for k in range(2, n)})
    for k in range(2, n + 1):
        later = f"filter(all{k}, x -> x > t{k - 1} AND x <= t1 + {span})"
        per_user = per_user.withColumn(f"t{k}", F.expr(f"array_min({later})"))
    columns = [F.col("user_id"), _passed(n).alias("reached")]
    for k in range(1, n if pairs else 1):
        first = "t1" if k == 1 else f"first{k}"
        follows = f"exists(all{k + 1}, x -> x > {first} AND x <= {first} + {span})"
        columns.append(F.expr(f"CASE WHEN {first} IS NULL THEN 0 WHEN {follows} THEN 2 ELSE 1 END").alias(f"pair_{k}"))
    return per_user.select(*columns)


def _heavy_reach(rows: DataFrame, steps: list[str], window_days: int, pairs: bool, slice_rows: int) -> DataFrame:
    """The same for heavy users, from two passes over their rows, whatever the number of steps.

    The first pass finds when each user began, a row a user, which is written. The second reduces what follows to a row
    for each time of a user, with the steps that were done at it; so all times differ, and a step taken in one row can't be followed
    by another in the same. These rows are cut into slices, each slice becomes a table "steps reached before -> reached after", and
    the tables of a user are composed.
    """
    n = len(steps)
    window = F.make_dt_interval(F.lit(window_days))
    firsts = rows.groupBy("user_id").agg(
        F.min(_at(steps[0])).alias("t1"),
        *[F.min(_at(steps[k - 1])).alias(f"first{k}") for k in range(2, n if pairs else 2)],
    )
    firsts = materialise(firsts if pairs else firsts.filter(F.col("t1").isNotNull()), "heavy-starts")

    inside = (F.col("ts") > F.col("t1")) & (F.col("ts") <= F.col("t1") + window)
    bits = [F.when(F.col("event") == step, 1 << k).otherwise(0) for k, step in enumerate(steps)]
    done = sum(bits[1:], bits[0])
    hits = []
    for k in range(1, n if pairs else 1):
        first = F.col("t1" if k == 1 else f"first{k}")
        follows = (F.col("event") == steps[k]) & (F.col("ts") > first) & (F.col("ts") <= first + window)
        hits.append(F.coalesce(F.max(follows), F.lit(False)).alias(f"hit_{k}"))
    mask = F.coalesce(F.bit_or(F.when(inside, done)), F.lit(0)).alias("done")
    times = rows.join(firsts, "user_id").groupBy("user_id", "ts").agg(mask, *hits)
    order = ("user_id", "ts")
    ordered = times.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered, "heavy-times").withColumn("slice", F.expr(f"at div {slice_rows}"))

    # Step k is bit k - 1, so that whoever reached m steps waits for bit m; nobody waits for bit n.
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ts", "done"))), lambda x: x["done"])
    after = lambda m: F.aggregate("listed", m, lambda at, d: at + F.when(F.getbit(d, at) == 1, 1).otherwise(0))
    moves = F.array(F.transform(F.sequence(F.lit(0), F.lit(n)), after))
    tables = ordered.filter("done > 0").groupBy("user_id", "slice").agg(listed.alias("listed")).select("user_id", "slice", moves.alias("moves"))
    chained = composed(tables, ["user_id"]).select("user_id", F.get(F.get("moves", F.lit(0)), F.lit(1)).alias("furthest"))
    found = firsts.join(chained, "user_id", "left")
    reached = F.when(F.col("t1").isNull(), 0).otherwise(F.coalesce("furthest", F.lit(1))).alias("reached")
    if not pairs:
        return found.select("user_id", reached)
    pair = ordered.groupBy("user_id").agg(*[F.max(f"hit_{k}").alias(f"hit_{k}") for k in range(1, n)])
    columns = [F.when(F.col("t1" if k == 1 else f"first{k}").isNull(), 0).when(F.col(f"hit_{k}"), 2).otherwise(1).alias(f"pair_{k}") for k in range(1, n)]
    return found.join(pair, "user_id", "left").select("user_id", reached, *columns)


def funnel_reach(
    log: DataFrame,
    users: DataFrame,
    steps: str | Sequence[str],
    *,
    timeframe_days: Any = 90,
    conversion_window_days: Any = 14,
    filters: Mapping[str, Any] | None = None,
    properties: Sequence[str] = (),
    as_of: datetime | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
    with_pairs: bool = False,
) -> DataFrame:
    """``(user_id, reached)``: the furthest step each profiled user got to.

    Step 1 is the user's first matching event in the look-back; each next step is the first match
    strictly after the step before and at most the conversion window after step 1. ``with_pairs``
    adds ``pair_k``: 0, 1 or 2 steps reached in the funnel made of steps k and k+1 alone, and
    keeps users that never did step 1. Runs the surveying pass unless ``as_of`` and the heavy users are given.
    """
    names = funnel_steps(steps)
    window = as_int(conversion_window_days, 14)
    condition = profile_condition(filters, properties)
    cohort = (users if condition is None else users.filter(condition)).select("user_id")
    days = as_int(timeframe_days, 90)
    as_of, skew = surveyed(log, days, as_of, skew)
    rows = within(log, days, as_of).filter(F.col("event").isin(sorted(set(names))))
    # A filtered cohort thins out the events before their shuffle; the whole population does not,
    # and is matched against one row per user afterwards, on the same partitioning.
    light, heavy = skew.split(rows, cohort if condition is not None else None)
    reaches = [_light_reach(light, names, window, with_pairs)]
    if heavy is not None:
        reaches.append(_heavy_reach(heavy, names, window, with_pairs, skew.slice_rows))
    if condition is None:
        reaches = [r.join(cohort, "user_id", "left_semi") for r in reaches]
    return reaches[0] if heavy is None else reaches[0].unionByName(reaches[1])


def step_counts(n: int, weight: Column | None = None) -> list[Column]:
    """Users at each step, ``at_1 .. at_n``, as aggregates over ``reached``."""
    one = F.lit(1) if weight is None else weight
    counts = [F.sum(F.when(F.col("reached") >= k, one)) for k in range(1, n + 1)]
    return [F.coalesce(c, F.lit(0)).cast("bigint").alias(f"at_{k}") for k, c in enumerate(counts, 1)]


def step_rows(counts: DataFrame, steps: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per step from rows with ``at_1 .. at_n``."""
    items = []
    for k, event in enumerate(steps, 1):
        here, previous = F.col(f"at_{k}"), F.col(f"at_{max(k - 1, 1)}")
        items.append(
            F.struct(
                F.lit(k).alias("step"), F.lit(event).alias("event"), here.alias("users"), previous.alias("previous")
            )
        )
    rows = counts.select(*keys, F.col("at_1").alias("started"), F.inline(F.array(*items)))
    return rows.select(
        *keys,
        "step",
        "event",
        "users",
        share("users", "started").alias("conversion_from_start"),
        missing_share("users", "previous").alias("lost_from_previous"),
    )


def funnel_steps_table(reach: DataFrame, steps: str | Sequence[str]) -> DataFrame:
    """Users, conversion from the start and loss from the step before, per step."""
    names = funnel_steps(steps)
    return step_rows(reach.agg(*step_counts(len(names))), names)


def funnel_by_property(
    reach: DataFrame, users: DataFrame, steps: str | Sequence[str], prop: str, properties: Sequence[str]
) -> DataFrame:
    """The step table for each of the 8 property values with most users at step 1."""
    names = funnel_steps(steps)
    values = users.select("user_id", F.col(known_property(prop, properties)).alias("value"))
    counts = reach.join(values, "user_id").filter(F.col("value").isNotNull()).groupBy("value").agg(*step_counts(len(names)))
    top = counts.orderBy(F.desc("at_1"), "value").limit(TOP_VALUES)
    return step_rows(top, names, ["value"])


def worst_loss(n: int) -> Column:
    """Struct ``(lost, step)`` of the largest loss between consecutive steps; the first wins ties."""
    losses = [
        F.struct((F.col(f"at_{k}") - F.col(f"at_{k + 1}")).alias("lost"), F.lit(-k).alias("order"), F.lit(k).alias("step"))
        for k in range(1, n)
    ]
    return F.array_max(F.array(*losses))


def funnel_summary(reach: DataFrame, steps: str | Sequence[str]) -> DataFrame:
    """One row: start and end users, conversion, and the step that loses most users."""
    names = funnel_steps(steps)
    n = len(names)
    counts = reach.agg(*step_counts(n)).withColumn("worst", worst_loss(n))
    labels = F.array(*[F.lit(s) for s in names])
    before = ", ".join(f"at_{k}" for k in range(1, n + 1))
    started = F.col("at_1") > 0
    step = F.col("worst.step")
    return counts.select(
        F.col("at_1").alias("started_users"),
        F.col(f"at_{n}").alias("converted_users"),
        share(f"at_{n}", "at_1").alias("conversion"),
        F.when(started, step).alias("worst_step"),
        F.when(started, F.get(labels, step - 1)).alias("worst_from"),
        F.when(started, F.get(labels, step)).alias("worst_to"),
        F.when(started, F.col("worst.lost")).alias("lost_users"),
        F.when(started, share("worst.lost", f"get(array({before}), worst.step - 1)")).alias("lost_pct"),
    )


def stalled_users(reach: DataFrame, steps: str | Sequence[str], at_step: Any) -> DataFrame:
    """Users that got to ``at_step`` and no further."""
    n, k = len(funnel_steps(steps)), as_int(at_step, 0)
    if not 1 <= k < n:
        raise ValueError(f"a stalled step must be between 1 and {n - 1}")
    return reach.filter(F.col("reached") == k).select("user_id")


def converted_users(reach: DataFrame, steps: str | Sequence[str]) -> DataFrame:
    return reach.filter(F.col("reached") >= len(funnel_steps(steps))).select("user_id")


def export_funnel_segments(
    store: SegmentStore,
    reach: DataFrame,
    steps: str | Sequence[str],
    *,
    base_name: str,
    stalled_at_step: Any = None,
    converted: Any = False,
) -> list[str]:
    """Write ``<base>_stalled`` and/or ``<base>_converted``; returns the names written.

    Both segments are cut from ``reach``; pass a materialised one if both are wanted.
    """
    exports = []
    if stalled_at_step not in (None, "") or as_flag(converted):
        base = required_text(base_name, "a segment base name")
        if stalled_at_step not in (None, ""):
            exports.append((f"{base}_stalled", stalled_users(reach, steps, stalled_at_step)))
        if as_flag(converted):
            exports.append((f"{base}_converted", converted_users(reach, steps)))
    store.write_all(exports)
    return [name for name, _ in exports]
