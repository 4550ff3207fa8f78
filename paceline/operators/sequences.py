"""Ordered event sequences per user.

A sequence is ordered by ``(ts, event)``. Light users are collected into one array each, in one shuffle. The rows of heavy
users (see ``heavy.py``) are dealt out by ranges of (user, ts, event) and numbered in order, so that slices of a bounded
number of rows follow from the numbers. What has to be known across slices (how many rows came before, which event came last)
is carried by windows over one slim row per slice, and joined back on (user, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.args import as_int, name_list, path_ends
from paceline.operators.heavy import DEFAULT_SKEW, SkewPolicy
from paceline.operators.lookback import surveyed, within
from paceline.session import materialise

ARROW = " -> "


@dataclass(frozen=True)
class Rows:
    """Events in scope, split by the skew policy; ``heavy`` is None if nobody is."""

    light: DataFrame
    heavy: DataFrame | None
    slice_rows: int


def scoped_rows(
    log: DataFrame,
    *,
    timeframe_days: Any = 90,
    allowed_events: str | Sequence[str] | DataFrame | None = None,
    segment: DataFrame | None = None,
    as_of: datetime | str | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> Rows:
    """Events of the look-back, of the allowed events and of a segment's users.

    ``allowed_events`` is a list or a frame with an ``event`` column; an empty list restricts nothing. Runs the
    surveying pass unless ``as_of`` and the heavy users are given.
    """
    days = as_int(timeframe_days, 90)
    as_of, skew = surveyed(log, days, as_of, skew)
    rows = within(log, days, as_of)
    if isinstance(allowed_events, DataFrame):
        rows = rows.join(allowed_events.select("event").distinct(), "event", "left_semi").select("user_id", "event", "ts")
    elif name_list(allowed_events):
        rows = rows.filter(F.col("event").isin(name_list(allowed_events)))
    members = None if segment is None else segment.select("user_id").distinct()
    light, heavy = skew.split(rows, members)
    return Rows(light, heavy, skew.slice_rows)


def _sorted_items(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def _without_repeats(name: str) -> Column:
    """The items of an array column whose event differs from the item before."""
    items = F.col(name)
    return F.filter(items, lambda x, i: (i == 0) | ~x["event"].eqNullSafe(F.get(items, i - 1)["event"]))


def _names(items: Column) -> Column:
    return F.transform(items, lambda x: x["event"])


def _positions(items: DataFrame, *keys: str) -> DataFrame:
    """One row per item of an array with its 1-based position."""
    rows = items.select("user_id", *keys, F.posexplode("items").alias("at", "item"))
    return rows.withColumn("pos", (F.col("at") + 1).cast("bigint")).select("user_id", *keys, "pos", "item.*")


def _light_items(rows: DataFrame, copies: bool = False) -> DataFrame:
    if not copies:
        return rows.groupBy("user_id").agg(_sorted_items("ts", "event").alias("items"))
    # Partitioned by user first, so that both groupings below share one shuffle.
    counted = rows.repartition("user_id").groupBy("user_id", "ts", "event").agg(F.count(F.lit(1)).alias("copies"))
    return counted.groupBy("user_id").agg(_sorted_items("ts", "event", "copies").alias("items"))


def _numbered(rows: DataFrame, slice_rows: int, *keys: str) -> DataFrame:
    """Distinct rows of heavy users with their number ``at`` in the order, and their ``slice``. Runs a job.

    Ranges of (user, ts, event) cut a user wherever that evens out the partitions; no two rows have one key.
    """
    distinct = rows.groupBy("user_id", *keys, "ts", "event").agg(F.count(F.lit(1)).alias("copies"))
    order = ("user_id", "ts", "event")
    ordered = distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialise(ordered, "ordered-rows").withColumn("slice", F.expr(f"at div {slice_rows}"))


def _across_slices() -> Any:
    """Over one row per slice, never over the rows of a user."""
    return Window.partitionBy("user_id").orderBy("slice")


def _onto(rows: DataFrame, slim: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their slice."""
    of = slim.select(F.col("user_id").alias("of_user"), F.col("slice").alias("of_slice"), *columns)
    same = rows["user_id"].eqNullSafe(of["of_user"]) & (rows["slice"] == of["of_slice"])
    return rows.join(of, same).drop("of_user", "of_slice")


def _before() -> Column:
    """Rows in the slices before."""
    return F.coalesce(F.sum("n").over(_across_slices().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")


def _heavy_sequences(numbered: DataFrame) -> DataFrame:
    slim = numbered.groupBy("user_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    placed = _onto(numbered, slim.select("user_id", "slice", "first_at", _before()), "before", "first_at")
    return placed.withColumn("pos", F.col("before") + F.col("at") - F.col("first_at") + 1)


def _heavy_compressed(numbered: DataFrame) -> DataFrame:
    """Numbered rows that do not repeat the event before, with ``pos``. Runs a job."""
    slim = numbered.groupBy("user_id", "slice").agg(F.min("at").alias("first_at"), F.max_by("event", "at").alias("last_event"))
    earlier = F.lag(F.struct("last_event")).over(_across_slices()).alias("earlier")
    inside = Window.partitionBy("user_id", "slice").orderBy("at")
    seamed = _onto(numbered, slim.select("user_id", "slice", "first_at", earlier), "first_at", "earlier")
    first = F.col("at") == F.col("first_at")
    previous = F.when(first, F.col("earlier.last_event")).otherwise(F.lag("event").over(inside))
    repeats = (~first | F.col("earlier").isNotNull()) & F.col("event").eqNullSafe(F.col("previous"))
    kept = seamed.withColumn("previous", previous).filter(~repeats).drop("previous", "earlier", "first_at")
    kept = materialise(kept.withColumn("rank", F.row_number().over(inside)), "compressed-rows")
    slim = kept.groupBy("user_id", "slice").agg(F.count(F.lit(1)).alias("n")).select("user_id", "slice", _before())
    return _onto(kept, slim, "before").withColumn("pos", (F.col("before") + F.col("rank")).cast("bigint"))


def user_sequences(rows: Rows) -> DataFrame:
    """``(user_id, pos, ts, event, copies)``; identical rows are one entry with their number."""
    light = _positions(_light_items(rows.light, copies=True))
    if rows.heavy is None:
        return light
    return light.unionByName(_heavy_sequences(_numbered(rows.heavy, rows.slice_rows)).select(*light.columns))


def compressed_sequences(rows: Rows) -> DataFrame:
    """``(user_id, pos, ts, event)`` without consecutive repeats of an event."""
    light = _positions(_light_items(rows.light).withColumn("items", _without_repeats("items")))
    if rows.heavy is None:
        return light
    return light.unionByName(_heavy_compressed(_numbered(rows.heavy, rows.slice_rows)).select(*light.columns))


# ------------------------------------------------------------------ journeys


@dataclass(frozen=True)
class Journeys:
    """From the start event to the end event, or to the end of the log where that was not reached.

    ``light``: ``(user_id, completed, events)``. ``steps``: ``(user_id, completed, slice, pos, event)``, the
    journeys of heavy users a row a step; None if nobody is heavy.
    """

    light: DataFrame
    steps: DataFrame | None


def journeys(rows: Rows, start: str, end: str) -> Journeys:
    """Each user's journey: the last start before the first end after the first start, up to that end;
    for users that never get to the end, everything from the first start on."""
    start, end = path_ends(start, end)
    steps = None if rows.heavy is None else _heavy_steps(rows.heavy, rows.slice_rows, start, end)
    return Journeys(_light_journeys(rows.light, start, end), steps)


def _light_journeys(rows: DataFrame, start: str, end: str) -> DataFrame:
    names = F.col("names")
    tail, head = F.col("tail"), F.col("head")
    done = F.array_position(tail, F.lit(end))
    back = F.col("back")
    has_start = F.bool_or(F.col("event") == start)
    return (
        rows.groupBy("user_id")
        .agg(_sorted_items("ts", "event").alias("items"), has_start.alias("has_start"))
        .filter("has_start")
        .withColumn("items", _without_repeats("items"))
        .select("user_id", _names(F.col("items")).alias("names"))
        .withColumn("first", F.array_position(names, F.lit(start)).cast("int"))
        .withColumn("tail", F.slice(names, F.greatest(F.col("first"), F.lit(1)), F.size(names)))
        .withColumn("done", done.cast("int"))
        .withColumn("head", F.slice(tail, F.lit(1), F.col("done")))
        .withColumn("back", F.array_position(F.reverse(head), F.lit(start)).cast("int"))
        .select(
            "user_id",
            (F.col("done") > 0).alias("completed"),
            F.when(F.col("done") > 0, F.slice(head, -F.greatest(back, F.lit(1)), back)).otherwise(tail).alias("events"),
        )
    )


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the state of their user. The state is written: adaptive execution knows its size, and can split the
    rows of one user if it is too large to broadcast."""
    known = materialise(state, "heavy-state").withColumnRenamed("user_id", "state_user")
    return rows.join(known, rows["user_id"].eqNullSafe(known["state_user"])).drop("state_user")


def _heavy_steps(rows: DataFrame, slice_rows: int, start: str, end: str) -> DataFrame:
    """Bounds by three conditional minima and maxima, then the rows between them, compressed. Runs jobs."""
    ts = F.col("ts")
    is_start, is_end = F.col("event") == start, F.col("event") == end
    after_first = ts >= F.col("first_start") if end > start else ts > F.col("first_start")
    before_end = ts <= F.col("end_at") if start < end else ts < F.col("end_at")

    state = rows.groupBy("user_id").agg(F.min(F.when(is_start, ts)).alias("first_start"))
    state = state.filter(F.col("first_start").isNotNull())
    state = _with_state(rows, state).groupBy("user_id", "first_start").agg(F.min(F.when(is_end & after_first, ts)).alias("end_at"))
    state = _with_state(rows, state).groupBy("user_id", "first_start", "end_at").agg(
        F.max(F.when(is_start & before_end, ts)).alias("last_start")
    )
    bounds = state.select(
        "user_id",
        F.col("end_at").isNotNull().alias("completed"),
        F.coalesce("last_start", "first_start").alias("from_ts"),
        F.col("end_at").alias("to_ts"),
    )
    here = F.struct("ts", "event")
    from_start = here >= F.struct(F.col("from_ts").alias("ts"), F.lit(start).alias("event"))
    to_end = here <= F.struct(F.col("to_ts").alias("ts"), F.lit(end).alias("event"))
    inside = _with_state(rows, bounds).filter(from_start & (F.col("to_ts").isNull() | to_end))
    steps = _heavy_compressed(_numbered(inside, slice_rows, "completed"))
    return materialise(steps.select("user_id", "completed", "slice", "pos", "event"), "journey-steps")


def journey_sequences(found: Journeys) -> DataFrame:
    """``(user_id, completed, pos, event)``: one row per step of a journey."""
    light = found.light.select("user_id", "completed", F.posexplode("events").alias("at", "event")).select(
        "user_id", "completed", (F.col("at") + 1).cast("bigint").alias("pos"), "event"
    )
    return light if found.steps is None else light.unionByName(found.steps.drop("slice"))


def _whole(steps: DataFrame) -> DataFrame:
    """``(user_id, events)``: whole journeys of heavy users, each in one row; for results that ask for just that."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "event")))
    return steps.groupBy("user_id").agg(F.transform(listed, lambda x: x["event"]).alias("events"))


def path_windows(found: Journeys) -> DataFrame:
    """``(user_id, events)`` of the users that reached the end event. A heavy user's path is one row, as asked for;
    to count paths use ``path_counts``."""
    light = found.light.filter("completed").select("user_id", "events")
    return light if found.steps is None else light.unionByName(_whole(found.steps.filter("completed")))


BLOCK_STEPS = 1000  # steps of a heavy path that are put side by side at a time
DIGEST = ["steps", "h1", "h2"]


def _same_path(a: DataFrame, b: DataFrame) -> Column:
    return (a["steps"] == b["of_steps"]) & (a["h1"] == b["of_h1"]) & (a["h2"] == b["of_h2"])


def _steps_of(paths: DataFrame, done: DataFrame) -> DataFrame:
    """``steps, h1, h2, pos, event`` of paths that hold their events, or name a heavy user who took them."""
    light = paths.filter(F.col("events").isNotNull()).select(*DIGEST, F.posexplode("events").alias("at", "event"))
    light = light.select(*DIGEST, (F.col("at") + 1).cast("bigint").alias("pos"), "event")
    heavy = paths.filter(F.col("events").isNull()).select(*DIGEST, "like")
    taken = done.join(heavy, done["user_id"].eqNullSafe(heavy["like"])).select(*DIGEST, "pos", "event")
    return light.unionByName(taken)


def _least_paths(group: DataFrame, done: DataFrame, need: int) -> DataFrame:
    """The ``need`` paths of least text, of any length.

    Digests of blocks of ``BLOCK_STEPS`` steps tell where the paths part first; only the texts of that block are put together. Paths
    before the wanted place are in, those behind it out, and those that still share it go on to where they part next.
    """
    chosen, after = [], -1
    while True:
        n = group.count()
        if n <= need:
            chosen.append(group)
            break
        rows = _steps_of(group, done).withColumn("block", F.expr(f"(pos - 1) div {BLOCK_STEPS}")).filter(F.col("block") > after)
        digests = rows.groupBy(*DIGEST, "block").agg(F.bit_xor(F.xxhash64("event", "pos")).alias("d"))
        parted = digests.groupBy("block").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
        after = parted.filter((F.col("low") != F.col("high")) | (F.col("n") < n)).agg(F.min("block")).first()[0]
        if after is None:  # paths of the same text
            chosen.append(group.orderBy("h1").limit(need))
            break
        listed = F.sort_array(F.collect_list(F.struct("pos", "event")))
        own = rows.filter(F.col("block") == after).groupBy(*DIGEST).agg(listed.alias("listed"))
        own = own.select(*[F.col(c).alias(f"of_{c}") for c in DIGEST], F.transform("listed", lambda x: x["event"]).alias("names"))
        goes_on = F.when(F.col("steps") > (after + 1) * BLOCK_STEPS, ARROW).otherwise("")
        text = F.when(F.col("names").isNull(), "").otherwise(F.concat(F.array_join("names", ARROW), goes_on))
        texts = materialise(group.join(own, _same_path(group, own), "left").select(*group.columns, text.alias("text")), "parting-paths")
        border = texts.orderBy("text").limit(need).agg(F.max("text")).first()[0]
        before = texts.filter(F.col("text") < border).drop("text")
        chosen.append(before)
        need -= before.count()
        group = texts.filter(F.col("text") == border).drop("text")
    found = chosen[0]
    for part in chosen[1:]:
        found = found.unionByName(part)
    return found


def _top_paths(counted: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The ``most`` travelled paths; among those of as many users the text decides, of heavy users' paths too."""
    users = [r["users"] for r in counted.select("users").orderBy(F.desc("users")).limit(most).collect()]
    if len(users) < most:
        return counted
    last = users[-1]
    need, tied = users.count(last), counted.filter(F.col("users") == last)
    light = tied.filter(F.col("events").isNotNull()).orderBy(F.array_join("events", ARROW), "h1").limit(need)
    group = materialise(light.unionByName(tied.filter(F.col("events").isNull())), "tied-paths")
    return counted.filter(F.col("users") > last).unionByName(_least_paths(group, done, need))


def path_counts(found: Journeys, most: int) -> DataFrame:
    """``(events, path, users)`` of the ``most`` travelled completed journeys, and the users of all, ``completed_users``.

    Paths are told apart by two hashes over their steps, which are combined map-side for heavy users; only the winners
    are put together. Among paths of as many users the text decides, whatever their length.
    """

    def hashed(event: Column, pos: Column) -> list[Column]:
        return [F.xxhash64(event, pos), F.xxhash64(pos, event)]

    def folded(which: int) -> Column:
        each = F.transform("events", lambda e, i: hashed(e, (i + 1).cast("bigint"))[which])
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))

    counted = (
        found.light.filter("completed")
        .select("events", F.size("events").cast("bigint").alias("steps"), folded(0).alias("h1"), folded(1).alias("h2"))
        .groupBy(*DIGEST)
        .agg(F.count(F.lit(1)).alias("users"), F.min("events").alias("events"))
        .withColumn("like", F.lit(None).cast(found.light.schema["user_id"].dataType))
    )
    if found.steps is not None:
        done = found.steps.filter("completed")
        h1, h2 = hashed(F.col("event"), F.col("pos"))
        heavy = done.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"))
        heavy = heavy.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("users"), F.min("user_id").alias("like"))
        counted = counted.unionByName(heavy, allowMissingColumns=True).groupBy(*DIGEST).agg(
            F.sum("users").alias("users"), F.min("events").alias("events"), F.min("like").alias("like")
        )
    counted = materialise(counted, "path-counts")
    if found.steps is None:
        top = counted.orderBy(F.desc("users"), F.array_join("events", ARROW), "h1").limit(most)
    else:
        top = materialise(_top_paths(counted, done, most), "top-paths")
        wanted = top.filter(F.col("events").isNull()).select(F.col("like").alias("of_user"))
        done = found.steps.filter("completed")
        own = _whole(done.join(wanted, done["user_id"].eqNullSafe(wanted["of_user"]), "left_semi"))
        own = own.select(F.col("user_id").alias("of_user"), F.col("events").alias("own"))
        top = top.join(own, F.col("events").isNull() & top["like"].eqNullSafe(own["of_user"]), "left")
        top = top.withColumn("events", F.coalesce("events", "own"))
    total = counted.agg(F.coalesce(F.sum("users"), F.lit(0)).alias("completed_users"))
    found_paths = top.select("events", F.array_join("events", ARROW).alias("path"), "users", F.lit(True).alias("some"))
    # One row, so that the users of all paths are there even if no path is.
    joined = total.join(found_paths, F.lit(True), "left").select("events", "path", "users", "completed_users")
    return joined.orderBy(F.desc_nulls_last("users"), "path")
