"""Clusters against plain Lloyd rounds in Python integers, and the work that the heaps save."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from math import floor, isfinite

import numpy as np
import pytest

from paceline.llm.heap_kmeans import Clusters, Heaps, cluster_vectors, next_heaps, squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, block long"


def plain_clusters(rows: list[tuple], k: int, rounds: int, dims: int) -> Counter:
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    place = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=place)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            if members := [v for (_, v), x in zip(kept, of, strict=True) if x == c]:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    of = assign()
    distances = [far(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    inertia = Counter()
    for c, d in zip(of, distances, strict=True):
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(distances), names[c]) for (i, _), c, d in zip(kept, of, distances, strict=True))


def found_clusters(spark, rows, **settings) -> Counter:
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    got = cluster_vectors(table, **settings)
    return Counter(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()))


def cloud(seed: int, n: int, dims: int, centres: int = 5) -> list[tuple]:
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(k, [x + draw.gauss(0, 0.4) for x in draw.choice(middles)]) for k in range(n)]


def test_equal_to_plain_rounds(spark):
    rows, history = cloud(1, 700, 6), []
    assert found_clusters(spark, rows, dims=6, history=history) == plain_clusters(rows, 8, 10, 6)
    assert history[0] == 700 and len(history) == 11
    assert history[-1] < 350  # most vectors are never compared again


def test_ties_and_copies(spark):
    """Whole coordinates on a small grid: many ties, equal vectors, equal ids, clusters that fall empty."""
    draw = random.Random(3)
    rows = [(draw.randrange(40), [draw.randrange(3) / 1024 for _ in range(4)]) for _ in range(300)]
    assert found_clusters(spark, rows, dims=4, k=9, rounds=6) == plain_clusters(rows, 9, 6, 4)


def test_one_vector_holds_a_third(spark):
    rows = [(k, [0.25, -0.5, 1.0]) for k in range(200)] + cloud(5, 400, 3)
    assert found_clusters(spark, rows, dims=3) == plain_clusters(rows, 8, 10, 3)


def test_awkward(spark):
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 1.0, 2.0]), (7, [1.0] * 4)]
    good = [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (8, [-0.0001, 0.0, 5.5]), (8, [-0.0001, 0.0, 5.5]), (9, [100.0, -100.0, 7.0])]
    for rows in (bad + good, good[:1], bad + good[2:4]):
        assert found_clusters(spark, rows, dims=3) == plain_clusters(rows, 8, 10, 3)
    assert not found_clusters(spark, bad, dims=3) and not found_clusters(spark, [], dims=3)
    with pytest.raises(Exception, match="components must stay below"):
        found_clusters(spark, [(1, [1e30, 0.0, 0.0])], dims=3)


def test_large_components_are_exact():
    draw = np.random.default_rng(2)
    x, c = draw.integers(-(1 << 27) + 1, 1 << 27, (20, 64)), draw.integers(-(1 << 27) + 1, 1 << 27, (3, 64))
    assert squared_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]


def test_only_expired_gaps_are_popped():
    """Round by round: what stays on a heap is where a full search would put it."""
    draw = np.random.default_rng(7)
    vectors = draw.integers(-2000, 2000, (500, 5))
    clusters, heaps = Clusters(vectors[:6].tolist(), [0.0] * 6, [[0] * 5 for _ in range(6)], [0] * 6), None
    for _ in range(12):
        heaps, popped, change = next_heaps(vectors, heaps, clusters)
        full = squared_distances(vectors, np.array(clusters.centroids)).argmin(axis=1)
        assert (full[heaps.rows] == heaps.clusters()).all()
        clusters = clusters.after(change.tolist())
        assert clusters.sizes == np.bincount(full, minlength=6).tolist()
    assert popped < 250
    assert Heaps.of(np.array([1, 0, 1]), np.arange(3), np.array([2.0, 5.0, 1.0]), 3).heads(np.array([1.0, 1.5, 9.0])).tolist() == [False, True, False]
