"""Exact k-means over integer vectors with heap-ordered bounds.

Vectors are packed once into blocks of rows, a table bucketed by block. Every round leaves a slim table of the same buckets:
for each block and cluster a heap of the cluster's vectors, ordered by how much its centroids may still move before the
vector can change. A vector that was compared with all centroids has a gap, the distance to the second nearest less that to the nearest;
it is stored as the gap plus the drift that its cluster has accumulated by then. A cluster's drift grows each round by
the way of its own centroid and the longest way of another. As long as a key is above the accumulated drift, the vector's nearest
centroid is still its nearest. So a round pops the head of each heap, the keys not above the drift, compares those vectors alone
with all centroids, and puts them on the heap of their nearest one. Heaps are kept as runs in ascending order.

Distances are compared as exact integers. Square roots are rounded, so that gaps are taken a billionth too small and drifts too large;
a vector that might be at a tie is always popped. Centroid sums are exact: a block passes on what joined and left each cluster, and these
changes are added up by Spark. The driver holds centroids and their sums, k times ``dims`` numbers.

Defined cases: vectors that are null, have another number of components, or hold a null, NaN or infinite one are left out; a
null ``vec_id`` is hashed as an empty string; repeated rows are vectors of their own, and start centroids with equal hashes are taken in the
order of their components; with fewer vectors than ``k`` there are as many clusters as vectors; ties go to the smaller cluster number;
an empty cluster keeps its centroid; an empty table gives an empty table; other columns are ignored. Components of 2**27 or more (after
scaling) end in an error, as a distance could then exceed 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import materialise, materialise_by

BLOCKS = "block long, n int, vec_ids binary, null_ids binary, vectors binary"
STATE = "block long, sizes binary, rows binary, keys binary, popped long, change array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"
LARGEST = 1 << 27
BLOCK_ROWS = 1024
SLACK = 1e-9


@dataclass(frozen=True)
class Clusters:
    """Centroids as integers, what each cluster's drift has come to, and the cluster's sums and sizes."""

    centroids: list[list[int]]
    drift: list[float] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def after(self, change: list[int]) -> Clusters:
        """The clusters once vectors have changed: sums, sizes, then centroids as exact floors, then drifts."""
        k, dims = len(self.centroids), len(self.centroids[0])
        sums = [[s + change[c * dims + d] for d, s in enumerate(row)] for c, row in enumerate(self.sums)]
        sizes = [n + change[k * dims + c] for c, n in enumerate(self.sizes)]
        moved = [[s // n for s in row] if n else old for row, n, old in zip(sums, sizes, self.centroids, strict=True)]
        ways = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 * (1 + SLACK) for x, y in zip(moved, self.centroids, strict=True)]
        others = [max((w for j, w in enumerate(ways) if j != c), default=0.0) for c in range(k)]
        return Clusters(moved, [d + w + o for d, w, o in zip(self.drift, ways, others, strict=True)], sums, sizes)


@dataclass(frozen=True)
class Heaps:
    """The heaps of one block: cluster after cluster, rows of vectors and their keys in ascending order."""

    sizes: np.ndarray
    rows: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(clusters: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int) -> Heaps:
        order = np.lexsort((keys, clusters))
        return Heaps(np.bincount(clusters, minlength=k), rows[order], keys[order])

    def clusters(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def heads(self, drift: np.ndarray) -> np.ndarray:
        """Which entries are popped: in each heap those before the first key above the drift."""
        ends = np.cumsum(self.sizes)
        popped = np.zeros(len(self.rows), bool)
        for start, end, most in zip(ends - self.sizes, ends, drift, strict=True):
            popped[start : start + np.searchsorted(self.keys[start:end], most, side="right")] = True
        return popped


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to every centroid."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * vectors.shape[1] * int(most) ** 2 < 1 << 53:  # every term and sum is exact in a double
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, gap to the second nearest, never too large) of each vector."""
    squares = squared_distances(vectors, centroids)
    cluster = squares.argmin(axis=1)
    best = np.take_along_axis(squares, cluster[:, None], 1)[:, 0]
    if len(centroids) == 1:
        return cluster, best, np.full(len(vectors), np.inf)
    second = np.partition(squares, 1, axis=1)[:, 1]
    return cluster, best, np.sqrt(second) * (1 - SLACK) - np.sqrt(best) * (1 + SLACK)


def next_heaps(vectors: np.ndarray, before: Heaps | None, clusters: Clusters) -> tuple[Heaps, int, np.ndarray]:
    """(heaps, vectors compared, change of every cluster's sum and size) of a block after a round."""
    k, centroids, drift = len(clusters.centroids), np.array(clusters.centroids, np.int64), np.array(clusters.drift)
    if before is None:
        popped, rows = np.ones(len(vectors), bool), np.arange(len(vectors))
        was, keys, left = np.full(len(vectors), -1), np.zeros(len(vectors)), np.zeros(len(vectors), np.int64) - 1
    else:
        popped, rows, keys = before.heads(drift), before.rows, before.keys
        was = left = before.clusters()
    again = rows[popped]
    now, _, gap = nearest(vectors[again], centroids)
    joined = np.concatenate([left[~popped], now]), np.concatenate([rows[~popped], again]), np.concatenate([keys[~popped], gap + drift[now]])
    moved, old = now != was[popped], was[popped]
    sums, sizes = np.zeros((k, vectors.shape[1]), np.int64), np.zeros(k, np.int64)
    np.add.at(sums, now[moved], vectors[again[moved]])
    np.add.at(sizes, now[moved], 1)
    gone = moved & (old >= 0)
    np.subtract.at(sums, old[gone], vectors[again[gone]])
    np.subtract.at(sizes, old[gone], 1)
    return Heaps.of(*joined, k), len(again), np.concatenate([sums.ravel(), sizes])


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _matrix(batch: pa.RecordBatch, k: int, dims: int) -> np.ndarray:
    return _array(batch["vectors"][k], "<i8").reshape(-1, dims)


def kept_vectors(table: DataFrame, dims: int) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    return table.select(F.col("vec_id").cast("long"), vector.alias("vector")).filter((F.size("vector") == dims) & F.forall("vector", finite))


def pack(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` vectors, as integers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                scaled = np.floor(scale * batch["vector"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
                if not np.abs(scaled).max() < LARGEST:
                    raise ValueError(f"components must stay below {LARGEST} after scaling")
                ids = batch["vec_id"]
                row = [number, batch.num_rows, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), scaled.astype("<i8").tobytes()]
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "n", "vec_ids", "null_ids", "vectors"])
                number += 1

    return kept.mapInArrow(blocks, BLOCKS)


def start_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the least hashes of ``seed:vec_id``, in the order of the hashes."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("vector", lambda x: F.floor(x * scale)).alias("vector")
    return [r["vector"] for r in kept.select(place.alias("place"), whole).orderBy("place", "vector").limit(k).collect()]


def one_round(blocks: DataFrame, state: DataFrame | None, clusters: Clusters, dims: int) -> DataFrame:
    """The next state of every block."""
    names, rows, begun = [x.split()[0] for x in STATE.split(", ")], blocks.select("block", "vectors"), state is not None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                before = None
                if begun:
                    before = Heaps(_array(batch["sizes"][i], "<i4"), _array(batch["rows"][i], "<i4"), _array(batch["keys"][i], "<f8"))
                heaps, popped, change = next_heaps(_matrix(batch, i, dims), before, clusters)
                blobs = [heaps.sizes.astype("<i4").tobytes(), heaps.rows.astype("<i4").tobytes(), heaps.keys.astype("<f8").tobytes()]
                columns = [batch["block"].slice(i, 1), *[pa.array([x], pa.binary()) for x in blobs], pa.array([popped], pa.int64()), pa.array([change.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    if state is not None:
        rows = rows.join(state.select("block", "sizes", "rows", "keys"), "block")
    return rows.mapInArrow(step, STATE)


def total_change(state: DataFrame) -> list[int]:
    """The blocks' changes added up: k * (dims + 1) numbers."""
    each = state.select(F.posexplode("change").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return [int(r["value"]) for r in sorted(each.collect())]


def assigned(blocks: DataFrame, state: DataFrame, clusters: Clusters, dims: int) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    centroids = clusters.centroids

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, ids = _matrix(batch, i, dims), _array(batch["vec_ids"][i], "<i8")
                null = np.unpackbits(_array(batch["null_ids"][i], "u1"))[: len(ids)].astype(bool)
                heaps = Heaps(_array(batch["sizes"][i], "<i4"), _array(batch["rows"][i], "<i4"), np.zeros(0))
                cluster = np.empty(len(ids), np.int32)
                cluster[heaps.rows] = heaps.clusters()
                distance = ((vectors - np.array(centroids, np.int64)[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    joined = blocks.select("block", "vec_ids", "null_ids", "vectors").join(state.select("block", "sizes", "rows"), "block")
    return joined.mapInArrow(rows_of, ASSIGNED)


def cluster_vectors(
    table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, history: list[int] | None = None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    ``history``, if given, gets the number of vectors that each round compared with all centroids.
    """
    spark = table.sparkSession
    kept = kept_vectors(table, dims)
    start = start_centroids(kept, k, seed, scale)
    if not start:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    k = len(start)
    clusters = Clusters(start, [0.0] * k, [[0] * dims for _ in range(k)], [0] * k)
    blocks = materialise_by(pack(kept, dims, scale), "block", "vector-blocks")
    state = None
    for turn in range(rounds + 1):
        state = materialise_by(one_round(blocks, state, clusters, dims), "block", "cluster-heaps", dealt=True)
        if history is not None:
            history.append(state.agg(F.sum("popped")).first()[0])
        if turn < rounds:
            clusters = clusters.after(total_change(state))
    found = materialise(assigned(blocks, state, clusters, dims), "assigned-vectors")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(exact.alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clusters.centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", of([sums.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )

