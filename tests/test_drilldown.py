from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

import plain
from profiles import PROPERTIES
from paceline.operators.drilldown import cohort_base, cohort_funnels, drilldown_report, drilldown_tree
from paceline.operators.heavy import SkewPolicy

DAY = datetime(2024, 1, 1)
STEPS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    users, rows = {}, []
    for i in range(6000):
        plan = rng.choice(["free", "pro", "team", None])
        users[i] = {"plan": plan, "country": rng.choice(["de", "fr"])}
        at = DAY + timedelta(hours=rng.randrange(200))
        chance = {"free": 0.25, "pro": 0.6}.get(plan, 0.5) - (0.15 if users[i]["country"] == "fr" else 0.0)
        for step in STEPS:
            rows.append((i, step, at))
            at += timedelta(hours=rng.randrange(1, 60))
            if rng.random() > chance:
                break
        if rng.random() < 0.1:
            rows.append((i, "b", DAY))
    return users, rows


@pytest.fixture(scope="module")
def frames(data, make_log, make_users):
    users, rows = data
    return make_log(rows), make_users([(i, u["plan"], u["country"]) for i, u in users.items()])


@pytest.mark.parametrize("skew", [SkewPolicy(), SkewPolicy(0, 100)])
def test_tree_equals_running_every_cohort(data, frames, skew):
    users, rows = data
    expected = plain.drilldown(rows, users, STEPS, PROPERTIES, 90, 2, 3)
    tree = drilldown_tree(*frames, STEPS, PROPERTIES, max_depth=3, conversion_window_days=2, skew=skew)
    found = {}
    for r in tree.collect():
        blockers = [(b.property, b.value) for b in r.blockers or []]
        at = [r.at_1, r.at_2, r.at_3]
        found[tuple(sorted(r.filters.items()))] = (r.depth, at, r.worst.step, r.worst.lost, blockers)
    assert found == expected
    assert max(depth for depth, *_ in found.values()) >= 2  # the data make the search go deep


def test_report_is_depth_first(frames):
    tree = drilldown_tree(*frames, STEPS, PROPERTIES, max_depth="2", conversion_window_days=2)
    lines = drilldown_report(tree, STEPS).collect()
    assert [r.line for r in lines] == list(range(1, len(lines) + 1))
    assert lines[0].cohort == "all users" and lines[0].depth == 0 and "lift -" in lines[0].blockers
    for before, line in zip(lines, lines[1:], strict=False):
        assert line.depth <= before.depth + 1
        if line.depth == before.depth + 1 and before.depth:
            assert line.cohort.startswith(before.cohort + ", ")


def test_depth_zero_is_the_root_alone(frames):
    tree = drilldown_tree(*frames, STEPS, PROPERTIES, max_depth=0).collect()
    assert [(r.signature, r.parent, r.depth, r.blockers) for r in tree] == [("{}", "", 0, None)]


def test_empty_log_has_an_empty_root(frames):
    log, users = frames
    tree = drilldown_tree(log.filter("event = 'zzz'"), users, STEPS, PROPERTIES)
    assert [(r.signature, r.at_1, r.blockers) for r in tree.collect()] == [("{}", 0, None)]


def test_cohort_funnels(data, frames):
    users, rows = data
    full = plain.reach(rows, users, STEPS, 90, 14)
    cohorts = [{}, {"plan": "pro"}, {"country": "fr", "plan": "free"}, {"plan": "nobody"}]
    table = cohort_funnels(cohort_base(*frames, STEPS, PROPERTIES), STEPS, cohorts, PROPERTIES).collect()
    counts = {(r.signature, r.step): r.users for r in table}
    assert len(table) == 12
    for text, filters in (("{}", {}), ('{"plan":"pro"}', cohorts[1]), ('{"country":"fr","plan":"free"}', cohorts[2])):
        inside = [r for u, r in full.items() if all(users[u][p] == v for p, v in filters.items())]
        assert [counts[text, k] for k in (1, 2, 3)] == [sum(r >= k for r in inside) for k in (1, 2, 3)]
    assert counts['{"plan":"nobody"}', 1] == 0
    with pytest.raises(ValueError):
        cohort_funnels(cohort_base(*frames, STEPS, PROPERTIES), STEPS, [{"shoe": "x"}], PROPERTIES)
