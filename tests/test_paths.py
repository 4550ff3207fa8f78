from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

import plain
from paceline.operators import sequences
from paceline.operators.heavy import SkewPolicy
from paceline.operators.paths import journey_map, journey_paths, journey_summary, product_paths
from paceline.operators.sequences import (
    compressed_sequences,
    journey_sequences,
    journeys,
    path_windows,
    scoped_rows,
    user_sequences,
)

DAY = datetime(2024, 1, 1)
SKEWS = {"light": SkewPolicy(), "some heavy": SkewPolicy(25, 10)}


def random_rows(seed, users=60, events="abcde", count=1500):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        user = 0 if rng.random() < 0.33 else rng.randrange(users)
        rows.append((user, rng.choice(events), DAY + timedelta(hours=rng.randrange(24 * 20))))
    return rows


@pytest.fixture(scope="module", params=SKEWS)
def skew(request):
    return SKEWS[request.param]


@pytest.fixture(scope="module")
def rows():
    return random_rows(11)


@pytest.fixture(scope="module")
def log(make_log, rows):
    return make_log(rows).cache()


def test_sequences(log, rows, skew):
    scoped = scoped_rows(log, timeframe_days=12, skew=skew)
    expected = {}
    for user, items in plain.histories(rows, 12).items():
        distinct = sorted(set(items))
        expected.update({(user, i): (*item, items.count(item)) for i, item in enumerate(distinct, 1)})
    assert {(r.user_id, r.pos): (r.ts, r.event, r.copies) for r in user_sequences(scoped).collect()} == expected
    squeezed = {
        (u, i): e for u, items in plain.histories(rows, 12).items() for i, e in enumerate(plain.squeeze(items), 1)
    }
    assert {(r.user_id, r.pos): r.event for r in compressed_sequences(scoped).collect()} == squeezed


@pytest.mark.parametrize("ends", [("a", "b"), ("e", "a")])
def test_journeys(log, rows, skew, ends):
    found = journeys(scoped_rows(log, skew=skew), *ends)
    expected = plain.journeys(rows, *ends)
    steps = {(r.user_id, r.pos): (r.completed, r.event) for r in journey_sequences(found).collect()}
    assert steps == {(u, i): (done, e) for u, (done, events) in expected.items() for i, e in enumerate(events, 1)}
    windows = {r.user_id: r.events for r in path_windows(found).collect()}
    assert windows == {u: events for u, (done, events) in expected.items() if done}


def test_product_paths(log, rows, skew):
    counts = plain.path_counts(plain.journeys(rows, "a", "b"))
    done = sum(n for _, n in counts)
    found = [tuple(r) for r in product_paths(log, "a", "b", top_n=4, skew=skew).collect()]
    assert sorted(found) == sorted((path, n, done) for path, n in counts[:4])
    kept = [r for r in rows if r[1] in "abc"]
    counts = plain.path_counts(plain.journeys(kept, "a", "b"))
    for allowed in ("c", log.sparkSession.createDataFrame([("c",)], "event string")):
        found = product_paths(log, "a", "b", allowed_events=allowed, top_n=100, skew=skew)
        assert {r.path: r.users for r in found.collect()} == dict(counts)


def test_journey_map(make_log, skew):
    # Sparse journeys, so that many are not completed and alignment has to choose.
    rows = random_rows(5, users=150, count=700)
    log = make_log(rows)
    found = plain.journeys(rows, "a", "b")
    nodes = {(r.step, r.event): (r.users, r.pct_of_start) for r in journey_map(log, "a", "b", skew=skew).collect()}
    assert nodes == plain.journey_nodes(found)
    top = plain.path_counts(found)[:5]
    assert [tuple(r) for r in journey_paths(log, "a", "b", skew=skew).collect()] == top
    summary = journey_summary(log, "a", "b", skew=skew).first()
    assert summary.started_users == len(found)
    assert summary.completed_users == sum(done for done, _ in found.values())
    totals = {}
    for (step, _), (n, _) in nodes.items():
        totals[step] = totals.get(step, 0) + n
    losses = [totals[i] - totals[i + 1] for i in range(len(totals) - 1)]
    assert summary.lost_users == max(losses)
    assert summary.worst_step == losses.index(max(losses)) + 1


def test_segment_scope(log, rows, skew):
    segment = log.sparkSession.createDataFrame([(0,), (1,), (2,), (777,)], "user_id bigint")
    kept = [r for r in rows if r[0] in (0, 1, 2)]
    found = {r.user_id for r in user_sequences(scoped_rows(log, segment=segment, skew=skew)).collect()}
    assert found == {r[0] for r in kept}
    nodes = journey_map(log, "a", "b", segment=segment, skew=skew).collect()
    assert {(r.step, r.event): (r.users, r.pct_of_start) for r in nodes} == plain.journey_nodes(
        plain.journeys(kept, "a", "b")
    )


ALL_HEAVY = SkewPolicy(0, 2)


@pytest.mark.parametrize(
    ("sequence", "window"),
    [
        (["s", "x", "s", "e"], ["s", "e"]),  # the last start before the end
        (["e", "s", "x", "e"], ["s", "x", "e"]),  # an end before any start is passed over
        (["x"], None),
        (["s", "x", "x", "s", "y", "y", "e", "e"], ["s", "y", "e"]),
        (["e", "s"], None),
    ],
)
def test_window_vectors(make_log, sequence, window):
    log = make_log([(1, e, i) for i, e in enumerate(sequence)])
    for skew in (SkewPolicy(), ALL_HEAVY):
        found = path_windows(journeys(scoped_rows(log, skew=skew), "s", "e")).collect()
        assert [r.events for r in found] == ([window] if window else [])


@pytest.mark.parametrize("skew", [SkewPolicy(), ALL_HEAVY])
def test_nobody_completed(make_log, skew):
    log = make_log([(1, "s", 0), (2, "s", 1), (2, "x", 2)])
    assert journey_map(log, "s", "e", skew=skew).count() == 0
    assert [tuple(r) for r in product_paths(log, "s", "e", skew=skew).collect()] == [(None, None, 0)]
    assert tuple(journey_summary(log, "s", "e", skew=skew).first()) == (2, 0, 0.0, None, None, None)


def test_ends_must_differ(log):
    with pytest.raises(ValueError):
        product_paths(log, "a", "a")
    with pytest.raises(ValueError):
        journey_map(log, "a", "")


def test_long_paths_are_ordered_by_all_their_steps(make_log):
    """Heavy users' paths that part after step 1,200, on a tie for the last place."""
    rows, texts = [], []
    for user, (middle, end) in enumerate([("cd", 1300), ("cd", 1290), ("dc", 1300), ("cd", 700)]):
        names = ["a"] + [("c" if k % 2 else "d") for k in range(1, 1200)]
        names += [middle[k % 2] for k in range(end - 1200)] if end > 1200 else []
        names = names[:end] + ["b"]
        steps = [x for k, x in enumerate(names) if k == 0 or x != names[k - 1]]
        rows += [(user, x, DAY + timedelta(minutes=k)) for k, x in enumerate(steps)]
        texts.append(" -> ".join(steps))
    log = make_log(rows)
    for most in (1, 3):
        found = product_paths(log, "a", "b", top_n=most, skew=SkewPolicy(0, 50)).collect()
        assert sorted(r.path for r in found) == sorted(texts)[:most]
        assert {r.completed_users for r in found} == {4}


@pytest.mark.parametrize("block", [1, 3])
def test_ties_are_settled_block_by_block(make_log, monkeypatch, block):
    """Short blocks, many paths of one user each, some of light users, prefixes of each other among them."""
    monkeypatch.setattr(sequences, "BLOCK_STEPS", block)
    rng = random.Random(block)
    rows = []
    for user in range(40):
        names = ["a", *(rng.choice(["c", "d", "cc", "c!"]) for _ in range(rng.randrange(6, 12) if user % 3 else 3)), "b"]
        rows += [(user, x, DAY + timedelta(hours=k)) for k, x in enumerate(names)]
    log = make_log(rows)
    expected = plain.path_counts(plain.journeys(rows, "a", "b"))
    for most, skew in ((4, SkewPolicy()), (4, SkewPolicy(7, 3)), (9, SkewPolicy(0, 2))):
        found = product_paths(log, "a", "b", top_n=most, skew=skew).collect()
        assert sorted((r.path, r.users) for r in found) == sorted(expected[:most])
