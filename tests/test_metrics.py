from __future__ import annotations

from datetime import date

import pytest

from profiles import PROPERTIES
from paceline.operators.lookback import within
from paceline.operators.metrics import insight
from paceline.sources.tables import event_catalog, event_log, property_values


@pytest.fixture(scope="module")
def log(make_log):
    # User 9 has no profile, user 3 no plan.
    return make_log([(1, "a", 0), (1, "a", 1), (2, "a", 7), (3, "a", 8), (9, "a", 9), (1, "b", 30), (2, "b", 29.5)])


@pytest.fixture(scope="module")
def users(make_users):
    return make_users([(1, "free", "de"), (2, "pro", "de"), (3, None, "fr"), (4, "pro", "fr")])


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_cutoff_is_inclusive_and_anchored_at_the_newest_event(log):
    assert within(log, 30).count() == 7
    assert within(log, 29).count() == 6
    assert within(log, 0).count() == 1


def test_known_newest_time_and_day_partitions_give_the_same(log, spark, tmp_path):
    newest = max(r.ts for r in log.collect())
    assert within(log, 22, as_of=newest).count() == within(log, 22).count() == 4
    path = str(tmp_path / "by_day")
    log.selectExpr("*", "CAST(ts AS DATE) AS day").write.partitionBy("day").parquet(path)
    by_day = event_log(spark.read.parquet(path), day="day")
    recent = within(by_day, 22)
    assert recent.count() == 4
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()


def test_empty_log_gives_empty_results(make_log):
    empty = make_log([(1, "a", 0)]).filter("false")
    assert rows(insight(empty, events="a")) == [("all users", 0)]
    assert rows(insight(empty, events="a", by_week=True)) == []


def test_totals_count_users_without_profile_and_grouping_does_not(log, users):
    assert rows(insight(log, events="a", timeframe_days=60)) == [("all users", 4)]
    assert rows(insight(log, events="a", metric="event_count", timeframe_days=60)) == [("all users", 5)]
    grouped = insight(log, users, events="a", timeframe_days=60, group_by="country", properties=PROPERTIES)
    assert rows(grouped) == [("de", 2), ("fr", 1)]
    counted = insight(
        log, users, events="a", metric="event_count", timeframe_days=60, group_by="plan", properties=PROPERTIES
    )
    assert rows(counted) == [("free", 2), ("pro", 1)]  # the group without a value is dropped


def test_group_limit_comes_before_dropping_the_missing_value(make_log, make_users):
    people = [(i, f"p{i:02}" if i else None, "de") for i in range(14)]
    log = make_log([(i, "a", n) for i in range(14) for n in range(3 if i == 0 else 1)])
    result = insight(
        log, make_users(people), events="a", metric="event_count", group_by="plan", properties=PROPERTIES
    )
    assert [g for g, _ in rows(result)] == [f"p{i:02}" for i in range(1, 12)]


def test_filters_and_weeks(log, users):
    weekly = insight(log, events=["a", "b"], by_week="true", group_by="nonsense", timeframe_days=60)
    assert rows(weekly) == [(date(2024, 1, 1), 1), (date(2024, 1, 8), 3), (date(2024, 1, 29), 2)]
    only = insight(log, users, events="a", timeframe_days=60, filters={"country": "de"}, properties=PROPERTIES)
    assert rows(only) == [("all users", 2)]


def test_bad_arguments(log, users):
    with pytest.raises(ValueError):
        insight(log, events="a", metric="revenue")
    with pytest.raises(ValueError):
        insight(log, users, events="a", group_by="shoe", properties=PROPERTIES)
    with pytest.raises(ValueError):
        insight(log, events=[f"e{i}" for i in range(21)])
    with pytest.raises(ValueError):
        insight(log, events="a", group_by="plan", properties=PROPERTIES)


def test_dictionaries(log, users):
    assert sorted(rows(event_catalog(log))) == [("a", 5, 4), ("b", 2, 2)]
    found = sorted(rows(property_values(users, PROPERTIES)))
    assert found == [("country", "de"), ("country", "fr"), ("plan", "free"), ("plan", "pro")]
