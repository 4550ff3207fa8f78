from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

import plain
from profiles import PROPERTIES
from paceline.functions.numeric import missing_share
from paceline.operators.breakdown import breakdown_entries, top_entries
from paceline.operators.funnel import (
    export_funnel_segments,
    funnel_by_property,
    funnel_reach,
    funnel_steps_table,
    funnel_summary,
    stalled_users,
)
from paceline.operators.heavy import SkewPolicy, survey
from paceline.operators.paths import product_paths
from paceline.sources.segments import SegmentStore

DAY = datetime(2024, 1, 1)
MICRO = timedelta(microseconds=1)
STEPS = ["a", "b", "c"]


def reached(log, users, steps=STEPS, **options):
    return {r.user_id: r.reached for r in funnel_reach(log, users, steps, **options).collect()}


@pytest.fixture(scope="module")
def people(make_users):
    return make_users([(i, "pro" if i % 3 else "free", "de" if i % 2 else "fr") for i in range(40)])


def random_rows(seed, users=40, events="abcx", count=1200):
    """User 0 does a third of everything; times are coarse, so that many coincide."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        user = 0 if rng.random() < 0.33 else rng.randrange(users)
        rows.append((user, rng.choice(events), DAY + timedelta(hours=rng.randrange(24 * 40))))
    return rows


SKEWS = {"none": SkewPolicy(), "some": SkewPolicy(20, 15), "all": SkewPolicy(0, 3)}


@pytest.mark.parametrize("skew", ["none", "some"])
@pytest.mark.parametrize("steps", [["a", "a", "b"], ["c", "x", "a", "b"]])
def test_reach_equals_plain_restatement(make_log, people, steps, skew):
    rows = random_rows(len(steps) + len(skew))
    log = make_log(rows)
    for days, window in ((40, 2), (10, 30)):
        expected = plain.reach(rows, range(40), steps, days, window)
        options = {"timeframe_days": days, "conversion_window_days": window, "skew": SKEWS[skew]}
        assert reached(log, people, steps, **options) == expected


@pytest.mark.parametrize("skew", ["none", "some"])
def test_pair_reach_is_the_reach_of_the_pair_alone(make_log, people, skew):
    rows = random_rows(3)
    frame = funnel_reach(
        make_log(rows), people, STEPS, timeframe_days=15, conversion_window_days=1, skew=SKEWS[skew], with_pairs=True
    )
    for k in (1, 2):
        found = {r.user_id: r[f"pair_{k}"] for r in frame.collect() if r[f"pair_{k}"]}
        assert found == plain.reach(rows, range(40), STEPS[k - 1 : k + 1], 15, 1)
    full = {r.user_id: r.reached for r in frame.collect() if r.reached}
    assert full == plain.reach(rows, range(40), STEPS, 15, 1)


@pytest.mark.parametrize("skew", ["none", "all"])
def test_window_edges(make_log, people, skew):
    week = timedelta(days=7)
    log = make_log([
        (1, "a", DAY), (1, "b", DAY),                                  # same time: not after
        (2, "a", DAY), (2, "b", DAY + MICRO),                          # just after
        (3, "a", DAY), (3, "b", DAY + week),                           # last moment of the window
        (4, "a", DAY), (4, "b", DAY + week + MICRO),                   # too late
        (5, "a", DAY), (5, "a", DAY + 2 * week), (5, "b", DAY + 2 * week + MICRO),  # a restart is not retried
        (99, "a", DAY), (99, "b", DAY + MICRO),                        # no profile
    ])
    options = {"conversion_window_days": 7, "skew": SKEWS[skew]}
    assert reached(log, people, ["a", "b"], **options) == {1: 1, 2: 2, 3: 2, 4: 1, 5: 1}


@pytest.mark.parametrize("slice_rows", [1, 2, 3, 100])
@pytest.mark.parametrize("pairs", [False, True])
def test_slices_compose_to_the_light_path(spark, make_log, people, slice_rows, pairs):
    """Many equal times, on both sides of every border, steps that are asked for twice, and few composed at a time."""
    rng = random.Random(slice_rows)
    rows = [(u, rng.choice("abcd"), DAY + timedelta(hours=rng.randrange(12))) for u in range(8) for _ in range(40)]
    log = make_log(rows)
    for steps in (["a", "b", "c"], ["a", "b", "a", "d"], list("abcdab")):
        options = {"with_pairs": pairs, "conversion_window_days": 1}
        light = sorted(map(tuple, funnel_reach(log, people, steps, skew=SkewPolicy(), **options).collect()))
        heavy = funnel_reach(log, people, steps, skew=SkewPolicy(0, slice_rows), **options)
        assert sorted(map(tuple, heavy.collect())) == light


def test_filters_restrict_the_cohort(make_log, people):
    log = make_log([(1, "a", 0), (2, "a", 0), (3, "a", 0), (1, "b", 1)])
    for skew in (SKEWS["none"], SKEWS["all"]):
        found = reached(log, people, ["a", "b"], filters={"plan": "pro"}, properties=PROPERTIES, skew=skew)
        assert found == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        funnel_reach(log, people, ["a", "b"], filters={"shoe": "big"}, properties=PROPERTIES)


def test_step_table_and_summary(make_log, people):
    log = make_log(
        [(u, "a", 0) for u in range(8)] + [(u, "b", 1) for u in range(4)] + [(u, "c", 2) for u in range(1)]
    )
    reach = funnel_reach(log, people, STEPS)
    table = [tuple(r) for r in funnel_steps_table(reach, STEPS).collect()]
    assert table == [(1, "a", 8, 1.0, 0.0), (2, "b", 4, 0.5, 0.5), (3, "c", 1, 0.125, 0.75)]
    summary = funnel_summary(reach, STEPS).first()
    assert tuple(summary) == (8, 1, 0.125, 1, "a", "b", 4, 0.5)
    by_plan = funnel_by_property(reach, people, STEPS, "plan", PROPERTIES).filter("step = 1").collect()
    assert {(r.value, r.users) for r in by_plan} == {("pro", 5), ("free", 3)}


@pytest.mark.parametrize("base", [800, 20_000])
def test_loss_is_one_minus_the_rounded_quotient(spark, base):
    """Doubles decide near ties: 800 to 799 users loses 0.0012, not 0.0013."""
    found = spark.range(base + 1).select(missing_share("id", str(base)).alias("lost")).toPandas()["lost"].tolist()
    assert found == [round(1 - users / base, 4) for users in range(base + 1)]


def test_loss_in_the_step_table(spark):
    reach = spark.range(800).selectExpr("id AS user_id", "if(id = 0, 1, 2) AS reached")
    assert funnel_steps_table(reach, ["a", "b"]).collect()[1].lost_from_previous == round(1 - 799 / 800, 4) == 0.0012


def test_nobody_started(make_log, people):
    reach = funnel_reach(make_log([(1, "x", 0)]), people, STEPS)
    assert [r.users for r in funnel_steps_table(reach, STEPS).collect()] == [0, 0, 0]
    assert funnel_summary(reach, STEPS).first().worst_step is None
    assert breakdown_entries(reach, people, STEPS, PROPERTIES).count() == 0


def test_exports(spark, make_log, people, tmp_path):
    log = make_log([(1, "a", 0), (2, "a", 0), (2, "b", 1), (3, "a", 0), (3, "b", 1), (3, "c", 2)])
    reach = funnel_reach(log, people, STEPS)
    store = SegmentStore(spark, str(tmp_path / "segments"))
    names = export_funnel_segments(store, reach, STEPS, base_name="f", stalled_at_step="2", converted="yes")
    assert names == ["f_stalled", "f_converted"]
    assert [r.user_id for r in store.read("f_stalled").collect()] == [2]
    assert [r.user_id for r in store.read("f_converted").collect()] == [3]
    assert export_funnel_segments(store, reach, STEPS, base_name="", converted="false") == []
    with pytest.raises(ValueError):
        export_funnel_segments(store, reach, STEPS, base_name=" ", converted=True)
    for bad in (0, 3):
        with pytest.raises(ValueError):
            stalled_users(reach, STEPS, bad)


def test_breakdown_equals_plain_restatement(spark, make_log, make_users):
    rng = random.Random(8)
    users = {i: {"plan": rng.choice(["free", "pro", "team", None]), "country": f"c{rng.randrange(12)}"} for i in range(900)}
    rows = [(i, "a", DAY) for i in users]
    for i, u in users.items():
        if rng.random() < (0.3 if u["plan"] == "free" else 0.6):
            rows.append((i, "b", DAY + timedelta(days=1)))
    log, profiles = make_log(rows), make_users([(i, u["plan"], u["country"]) for i, u in users.items()])
    reach = funnel_reach(log, profiles, ["a", "b"])
    entries = breakdown_entries(reach, profiles, ["a", "b"], PROPERTIES)
    found = {(e.property, e.value): (e.conversion, e.lift, e.affected_users, e.impact) for e in entries.collect()}
    assert found == plain.breakdown(plain.reach(rows, users, ["a", "b"], 90, 14), users, PROPERTIES, 2)
    assert ("plan", "free") in found and found["plan", "free"][1] < 0
    top = {(e.kind, e.rank): e.impact for e in top_entries(entries).collect()}
    assert top["blocker", 1] == max(e[3] for e in found.values() if e[1] < 0)
    skipped = breakdown_entries(reach, profiles, ["a", "b"], PROPERTIES, filters={"plan": "free"})
    assert {e.property for e in skipped.collect()} == {"country"}


def test_survey_finds_newest_time_and_heavy_users(make_log):
    rows = [(u, "a", DAY + timedelta(minutes=i)) for u in range(30) for i in range(1 + 40 // (u + 1))]
    log = make_log([*rows, (None, "a", DAY), (None, "a", DAY + timedelta(hours=9, microseconds=1))])
    newest, skew = survey(log, None, SkewPolicy(5))
    assert newest == "2024-01-01 09:00:00.000001" and not skew.nobody
    assert {r.user_id for r in skew.known.collect()} == {u for u in range(30) if 1 + 40 // (u + 1) > 5}
    light, heavy = skew.split(log)
    assert light.count() + heavy.count() == len(rows) + 2 and heavy.count() > 0
    assert {r.user_id for r in survey(log, None, SkewPolicy(1))[1].known.filter("user_id is null").collect()} == {None}
    kept, nobody = survey(log, "2024-02-02", SkewPolicy(1000))
    assert kept == "2024-02-02" and nobody.nobody and nobody.split(log)[1] is None
    assert survey(log, kept, nobody) == (kept, nobody)


def test_rows_without_a_user_are_one_user(make_log):
    """Also if that user is heavy; funnels need a profile, paths do not."""
    log = make_log([(1, "a", 0), (1, "b", 1), (None, "a", 0), (None, "x", 0.5), (None, "b", 1)])
    for skew in (SkewPolicy(), SkewPolicy(0, 2)):
        found = {r.path: (r.users, r.completed_users) for r in product_paths(log, "a", "b", skew=skew).collect()}
        assert found == {"a -> b": (1, 2), "a -> x -> b": (1, 2)}
