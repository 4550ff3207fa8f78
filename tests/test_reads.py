"""How often analyses read the log, counted in input records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from profiles import PROPERTIES
from paceline.operators.funnel import funnel_reach, funnel_steps_table
from paceline.operators.heavy import SkewPolicy
from paceline.operators.lookback import within
from paceline.operators.paths import journey_map, product_paths
from paceline.operators.sequences import compressed_sequences, scoped_rows, user_sequences
from paceline.plans.reports import conversion_blockers, upgrade_paths, weekly_health
from paceline.session import materialise_by, scratch_path
from paceline.sources.segments import SegmentStore
from paceline.sources.tables import catalog_at, event_log, read_ordered_log, write_ordered_log

STEPS = ["a", "b", "c"]
USERS = 500


@pytest.fixture(scope="module")
def tables(make_log, make_users):
    rows = [(u, "abcd"[k % 4], u % 20 + k / 2) for u in range(USERS) for k in range(1 + u % 30)]
    return make_log(rows), make_users([(u, "pro" if u % 3 else "free", "de" if u % 2 else "fr") for u in range(USERS)]), len(rows)


def log_reads(spark, log, run) -> float:
    """Records that scans of the log's own files read while ``run`` builds and finishes a result, over the rows of the log."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in the plans
    path = log.inputFiles()[0]
    size = log.count()
    before = set(_scans(spark))
    run().write.format("noop").mode("overwrite").save()
    after = _scans(spark)
    return sum(n for key, (where, n) in after.items() if key not in before and path.split("/")[-1] in where) / size


def _scans(spark) -> dict:
    """(execution, node) -> (location, rows out) of all file scans that ran so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = {}
    for execution in _listed(store.executionsList()):
        graph = store.planGraph(execution.executionId())
        values = store.executionMetrics(execution.executionId())
        for node in _listed(graph.allNodes()):
            if "Scan" not in node.name():
                continue
            for metric in _listed(node.metrics()):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    text = str(values.apply(metric.accumulatorId())).replace(",", "").split("\\n")[-1].split(" ")[0]
                    found[execution.executionId(), node.id()] = (node.desc(), int(text or 0))
    return found


def _listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def test_the_count_itself(spark, tables):
    log, _, _ = tables
    assert log_reads(spark, log, lambda: log.select("user_id")) == 1
    assert log_reads(spark, log, lambda: within(log, 30)) == 2


def test_funnels_and_paths_read_the_log_twice(spark, tables):
    log, users, _ = tables
    assert log_reads(spark, log, lambda: funnel_steps_table(funnel_reach(log, users, STEPS), STEPS)) <= 2
    assert log_reads(spark, log, lambda: compressed_sequences(scoped_rows(log))) <= 2
    assert log_reads(spark, log, lambda: product_paths(log, "a", "b")) <= 2
    assert log_reads(spark, log, lambda: journey_map(log, "a", "b")) <= 2


@pytest.mark.parametrize("pairs", [False, True])
def test_heavy_funnels_read_the_log_as_often_for_any_number_of_steps(spark, tables, pairs):
    """A survey, and two passes over the rows of heavy users beside the one over those of the light ones, with two writes between."""
    log, users, _ = tables
    reads = [
        log_reads(spark, log, lambda steps=steps: funnel_reach(log, users, steps, skew=SkewPolicy(5, 4), with_pairs=pairs))
        for steps in (["a", "b"], ["a", "b", "c", "d"], list("abcdab"))
    ]
    assert max(reads) == min(reads) <= 4


@pytest.mark.parametrize("skew", [SkewPolicy(), SkewPolicy(20, 7)])
def test_reports_read_the_log_twice(spark, tables, skew):
    """A survey and one pass, with heavy users or without."""
    log, users, _ = tables

    def store():
        return SegmentStore(spark, scratch_path(spark, "segments"))

    assert log_reads(spark, log, lambda: conversion_blockers(log, users, store(), STEPS, PROPERTIES, stalled_at_step=1, base_name="f", skew=skew)) <= 2
    assert log_reads(spark, log, lambda: upgrade_paths(log, users, store(), goal="c", path_start="a", journey_start="b", segment_name="s", skew=skew)) <= 2
    options = {"signup_events": ["a"], "engagement_events": ["b", "d"], "steps": STEPS, "skew": skew}
    assert log_reads(spark, log, lambda: weekly_health(log, users, PROPERTIES, **options)) <= 2


def test_rows_by_user_need_no_exchange(spark, tables):
    """Grouping by the key of a bucketed table, and joining two of them."""
    log, _, _ = tables
    rows = materialise_by(log, "user_id", "rows")
    other = materialise_by(log.select("user_id").distinct(), "user_id", "users")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for frame in (rows.groupBy("user_id").count(), rows.join(other, "user_id"), rows.filter("event = 'a'").groupBy("user_id").agg(F.min("ts")).join(other, "user_id")):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, rows.collect())) == sorted(map(str, log.collect()))


def test_windows_of_heavy_users_are_slim(spark, tables):
    """No window and no shuffle keyed by user alone carries the rows of a heavy user."""
    log, _, _ = tables
    rows = scoped_rows(log, skew=SkewPolicy(0, 5))
    assert rows.heavy is not None
    for frame in (user_sequences(rows), compressed_sequences(rows)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if " Window [" in line or line.strip().startswith("Window [")]
        by_user = [w for w in windows if "slice" not in w.split("], [")[1]]
        assert by_user and all("event#" not in w.split("], [")[0].replace("last_event#", "") for w in by_user)


def test_day_partitions_are_pruned(spark, tables, tmp_path):
    log, users, _ = tables
    path = str(tmp_path / "days")
    log.selectExpr("*", "cast(ts as date) AS day").write.partitionBy("day").parquet(path)
    by_day = event_log(spark.read.parquet(path), day="day")
    frame = funnel_reach(by_day, users, STEPS, timeframe_days=10)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    same = funnel_reach(log, users, STEPS, timeframe_days=10)
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, same.collect()))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("as_of", [None, "2024-01-21 12:00:00"])
def test_row_groups_are_skipped_by_time(spark, make_log, tmp_path, kind, as_of):
    """A look-back that begins inside a day reads a part of that day."""
    log = make_log([(k % 50, "abcd"[k % 4], 20 + k / 20_000) for k in range(20_000)] + [(1, "a", 3)]).withColumn("ts", F.col("ts").cast(kind))
    path = str(tmp_path / "ordered")
    write_ordered_log(log, path, group_rows=500)
    ordered = read_ordered_log(spark, path)
    for days in (0, 1, 30):
        same = within(log, days, as_of)
        assert within(ordered, days, as_of).exceptAll(same).isEmpty() and same.exceptAll(within(ordered, days, as_of)).isEmpty()
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    before = set(_scans(spark))
    found = within(ordered, 0, "2024-01-21 23:00:00").collect()
    read = sum(n for key, (where, n) in _scans(spark).items() if key not in before and str(tmp_path) in where)
    assert 800 < len(found) <= read <= len(found) + 1100  # of 20,000 rows of the day


def test_logs_say_how_late_events_come(spark, tmp_path, make_log):
    """The newest event, filed eight days before the newest day, is found if the log says so; whoever asks."""
    rows = [(1, "a", "2024-01-20 10:00:00", "2024-01-20"), (2, "a", "2024-01-01 00:00:00", "2024-01-28"), (3, "a", "2024-01-19 00:00:00", "2024-01-19")]
    table = spark.createDataFrame(rows, "user_id bigint, event string, ts string, day string").selectExpr("user_id", "event", "cast(ts as timestamp_ntz) ts", "cast(day as date) day")
    assert {r.user_id for r in within(event_log(table, day="day", late_days=8), 2).collect()} == {1, 3}
    assert {r.user_id for r in within(event_log(table, day="day"), 2).collect()} != {1, 3}


def test_a_late_event_does_not_move_the_anchor(spark, make_log):
    rows = make_log([(1, "a", 1), (2, "a", 8), (3, "a", 9), (4, "a", 1)]).collect()
    days = ["2024-01-02", "2024-01-09", "2024-01-10", "2024-01-11"]  # the last event came in late
    log = spark.createDataFrame([(r.user_id, r.event, r.ts, d) for r, d in zip(rows, days, strict=True)], "user_id bigint, event string, ts timestamp_ntz, day string")
    log = log.selectExpr("user_id", "event", "ts", "cast(day as date) AS day")
    assert {r.user_id for r in within(log, 2).collect()} == {2, 3} == {r.user_id for r in within(log.drop("day"), 2).collect()}


def test_a_log_that_is_not_there_has_an_empty_catalog(spark, tables, tmp_path):
    log, _, _ = tables
    missing = catalog_at(spark, str(tmp_path / "nowhere"))
    assert missing["rows"].isEmpty() and "no event log" in missing["message"]
    log.write.parquet(str(tmp_path / "log"))
    found = catalog_at(spark, str(tmp_path / "log"))
    assert {r.event for r in found["rows"].collect()} == set("abcd") and found["message"] == ""
    assert found["rows"].schema.simpleString() == missing["rows"].schema.simpleString()
