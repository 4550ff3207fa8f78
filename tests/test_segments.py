from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from profiles import PROPERTIES
from paceline.operators.compare import compare_discoveries, compare_profiles
from paceline.operators.segments import define_segment, discover_events, discovery_summary, profile_segment
from paceline.sources.segments import SegmentStore


@pytest.fixture(scope="module")
def users(make_users):
    return make_users([(1, "free", "de"), (2, "pro", "de"), (3, None, "fr"), (4, "pro", "fr"), (5, "pro", None)])


@pytest.fixture(scope="module")
def log(make_log):
    return make_log([
        (1, "a", 0), (1, "a", 9), (2, "a", 9), (2, "b", 10), (3, "b", 10), (9, "a", 10), (9, "c", 10), (1, "b", 10),
    ])


def ids(frame):
    return sorted(r.user_id for r in frame.collect())


def test_rules(log, users):
    def segment(*rules, filters=None):
        return ids(define_segment(log, users, filters=filters, event_filters=rules, properties=PROPERTIES))

    assert segment() == [1, 2, 3, 4, 5]
    assert segment(filters={"plan": "pro"}) == [2, 4, 5]
    assert segment({"event": "a", "count": 2}) == [1]
    assert segment({"event": "a", "op": "at_most", "count": 0}) == [3, 4, 5]  # no events count as none
    assert segment({"event": "a", "count": 1, "timeframe_days": 1}) == [1, 2]
    two = ({"event": "a", "count": "1"}, {"event": "a", "op": "at_most", "count": 0, "timeframe_days": 0})
    assert segment(*two) == [1, 2]
    assert segment({"event": "b"}, filters={"country": "de"}) == [1, 2]
    with pytest.raises(ValueError):
        segment({"event": "a", "op": "exactly"})
    with pytest.raises(ValueError):
        segment({"op": "at_least"})


def test_store(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    three = spark.createDataFrame([(1,), (2,), (2,)], "user_id bigint")
    assert store.sizes().count() == store.table().count() == 0  # nothing written yet
    assert store.write("007", three) == 2
    assert store.write("007", three) == 2
    assert store.write("x/y=z", three.limit(1)) == 1
    assert {(r.segment_name, r.users) for r in store.sizes().collect()} == {("007", 2), ("x/y=z", 1)}
    assert ids(store.read("007")) == [1, 2]
    store.write("007", three.filter("user_id > 5"))
    assert {r.segment_name for r in store.sizes().collect()} == {"x/y=z"}
    for missing in ("007", "nobody"):
        with pytest.raises(ValueError, match="unknown or empty"):
            store.read(missing)
    with pytest.raises(ValueError, match="more than once"):
        store.write_all([("s", three), (" s", three)])
    assert "s" not in {r.segment_name for r in store.sizes().collect()}
    with pytest.raises(ValueError):
        store.write(" ", three)


@pytest.mark.parametrize("name", ["z\u00fcrich", "\u65e5\u672c", "a/b", "50%", "x y", "007", "a=b", "..", "_hidden", ".dot", "n\nl"])
def test_any_name(spark, tmp_path, name):
    store = SegmentStore(spark, str(tmp_path / "store"))
    assert store.write_all([(name, spark.range(3).withColumnRenamed("id", "user_id"))]) == {name: 3}
    assert ids(store.read(name)) == [0, 1, 2]
    assert ids(store.table().filter(F.col("segment_name") == name)) == [0, 1, 2]
    assert [tuple(r) for r in store.sizes().collect()] == [(name, 3)]


def test_a_failed_write_leaves_the_segment(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    store.write("s", spark.range(3).withColumnRenamed("id", "user_id"))
    earlier = store.read("s")
    with pytest.raises(Exception, match="broken"):
        store.write("s", spark.range(3).select(F.expr("raise_error('broken')").cast("long").alias("user_id")))
    assert ids(store.read("s")) == [0, 1, 2]
    store.write("s", spark.range(1).withColumnRenamed("id", "user_id"))
    assert ids(earlier) == [0, 1, 2] and ids(store.read("s")) == [0]  # who reads the old version goes on reading it


def test_segments_written_together_are_replaced_alone(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "user_id bigint")
    assert store.write_all([("a", some(1, 2, 2)), ("b", some(2)), ("none", some())]) == {"a": 2, "b": 1, "none": 0}
    assert store.write_all([]) == {}
    store.write("a", some(7))
    assert sorted(map(tuple, store.table().collect())) == [("a", 7), ("b", 2)]
    assert sorted(map(tuple, store.sizes().collect())) == [("a", 1), ("b", 1)]
    assert ids(store.read("b")) == [2]
    store.write("b", some())
    with pytest.raises(ValueError):
        store.read("b")
    assert [tuple(r) for r in store.table().collect()] == [("a", 7)]


def test_a_write_is_one_job_and_a_row_of_versions(spark, tmp_path):
    """The members are computed once, whatever the number of segments, and not read again for their sizes."""
    store, tracker = SegmentStore(spark, str(tmp_path / "store")), spark.sparkContext.statusTracker()
    frames = [(f"s{k}", spark.range(100, numPartitions=2).filter(f"id % 3 = {k}").withColumnRenamed("id", "user_id")) for k in range(3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else each shuffle is a job of its own
    spark.sparkContext.setJobGroup("one write", "")
    try:
        assert store.write_all(frames) == {"s0": 34, "s1": 33, "s2": 33}
        assert len(tracker.getJobIdsForGroup("one write")) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_discovery(spark, log, users):
    segment = spark.createDataFrame([(1,), (2,), (2,)], "user_id bigint")
    rows = [tuple(r) for r in discover_events(log, users, segment).collect()]
    # The population counts user 9, who has no profile; an event the segment never did ranks first.
    assert rows == [("c", 0.0, 0.2, 0.0), ("a", 1.0, 0.6, 1.6667), ("b", 1.0, 0.6, 1.6667)]
    assert [r.event for r in discover_events(log, users, segment, top_n=1).collect()] == ["c"]
    assert tuple(discovery_summary(discover_events(log, users, segment)).first())[:2] == ("over", "a")
    only_c = discover_events(log, users, segment, top_n=1)
    assert tuple(discovery_summary(only_c).first())[:2] == ("under", "c")


def test_profile(spark, users):
    segment = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    rows = [tuple(r) for r in profile_segment(users, segment, PROPERTIES).collect()]
    # Missing values stay in the sizes but are not reported; values absent from the segment are not either.
    assert rows == [("country", "de", 1.0, 0.4, 1.5), ("plan", "free", 0.5, 0.2, 1.5)]
    tight = profile_segment(users, segment, PROPERTIES, min_relative_change="1.6")
    assert tight.count() == 0


def test_comparisons(spark):
    shape = "event string, segment_pct double, population_pct double, lift double"
    a = spark.createDataFrame([("x", 0.5, 0.3, 1.0), ("y", 0.32, 0.3, 1.0), ("z", 0.9, 0.2, 1.0)], shape)
    b = spark.createDataFrame([("x", 0.4, 0.3, 1.0), ("y", 0.3, 0.3, 1.0), ("w", 0.1, 0.6, 1.0)], shape)
    rows = [tuple(r) for r in compare_discoveries(a, b).collect()]
    assert rows == [("z", 0.9, 0.2, 0.7), ("w", 0.6, 0.1, 0.5), ("x", 0.5, 0.4, 0.1)]
    pa, pb = (f.selectExpr("'p' AS property", "event AS value", "segment_pct", "population_pct") for f in (a, b))
    assert [r.value for r in compare_profiles(pa, pb).collect()] == ["z", "w", "x"]
