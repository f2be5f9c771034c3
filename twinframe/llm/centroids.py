"""Centroid clustering in integers, with most centroids ruled out in a rotated space.

Vectors are stored once with their leading principal coordinates and the norm of what is left. For a vector and a centroid,
the squared distance of the leading coordinates plus the squared difference of the two norms is never above the squared
distance of the whole; a centroid whose bound lies above the best exact distance is skipped, all others are measured in
integers. The rotation is in floating point and decides only what is skipped, with a margin for its rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, small_batches

#: Components of this size or more, in steps, are left out: squared distances of 64 of them would pass 63 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dims: int = 64, steps: int = 64) -> DataFrame:
    """vec_id, q array<int>: floor(steps * x) of the vectors (vec_id, embedding) of dims finite components."""
    scaled = F.transform(vectors["embedding"], lambda x: x.cast("double") * steps)
    whole = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -LARGEST) & (x < LARGEST))
    rows = vectors.select(vectors["vec_id"].alias("vec_id"), scaled.alias("s"), whole.alias("whole"))
    return rows.where((F.size("s") == dims) & F.col("whole")).select("vec_id", F.transform("s", lambda x: F.floor(x).cast("int")).alias("q"))


def _matrix(column: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)


def _lists(a: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(a).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, a.shape[1], dtype=np.int32)), pa.array(flat))


def principal_axes(ints: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (axes as columns, the widest first) of all vectors; the driver gets dims * (dims + 1) + 1 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([_lists(np.concatenate([[n], s, m.ravel()])[None])], names=["m"])

    rows = ints.select("q").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    at = np.zeros(1 + dims + dims * dims)
    for r in rows:
        at[r["i"]] = r["v"]
    if not at[0]:
        return np.zeros(dims), np.eye(dims)
    mean, second = at[1 : 1 + dims] / at[0], at[1 + dims :].reshape(dims, dims) / at[0]
    return mean, np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1]


class Rotation:
    """Leading coordinates and the norm of the rest, of vectors less their mean."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.mean, self.axes = mean, np.ascontiguousarray(axes[:, :lead])

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = q.astype(np.float64) - self.mean
        lead = x @ self.axes
        return lead, np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) - (lead * lead).sum(axis=1)))


def rotated(ints: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """vec_id, q, lead array<double>, rest double."""
    def run(batches):
        for batch in batches:
            lead, rest = rotation(_matrix(batch.column(1), dims, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(lead), pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    return ints.mapInArrow(run, f"vec_id {dict(ints.dtypes)['vec_id']}, q array<int>, lead array<double>, rest double")


def lower_bounds(lead: np.ndarray, rest: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> np.ndarray:
    """A row for each vector, a column for each centroid: at most the squared distance.

    Rounding is taken off: sums of a few dozen products err by less than 1e-10 of the norms' squares, and norms that are
    what a difference of such sums leaves by less than 1e-6 of the whole norms.
    """
    bound = np.empty((len(lead), len(c_lead)))
    own = (lead * lead).sum(axis=1) + rest * rest
    for c in range(len(c_lead)):
        gap, norms = lead - c_lead[c], own + c_lead[c] @ c_lead[c] + c_rest[c] ** 2
        beside = np.maximum(0.0, np.abs(rest - c_rest[c]) - 1e-6 * np.sqrt(norms))
        bound[:, c] = (gap * gap).sum(axis=1) + beside * beside - 1e-10 * norms - 1e-6
    return bound


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, the smaller of equals; the exact squared distance; and how many were measured."""
    bound = lower_bounds(lead, rest, c_lead, c_rest)
    best = bound.argmin(axis=1) if len(q) else np.zeros(0, np.int64)
    distance = ((q - centroids[best]) ** 2).sum(axis=1)
    first, measured = best.copy(), len(q)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= distance) & (first != c))
        if len(rows):
            measured += len(rows)
            d = ((q[rows] - centroids[c]) ** 2).sum(axis=1)
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
            best[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
    return best, distance, measured


def _near(batch: pa.RecordBatch, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dims = centroids.shape[1]
    q, lead = _matrix(batch.column("q"), dims, np.int64), _matrix(batch.column("lead"), rotation.axes.shape[1])
    best, distance, _ = nearest(q, lead, batch.column("rest").to_numpy(), centroids, *rotation(centroids))
    return q, best, distance


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each one's vectors, exact; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            q, best, _ = _near(batch, centroids, rotation)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best):
                sums[c] += q[best == c].sum(axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n[own], pa.int64()), _lists(sums[own])], names=["c", "n", "s"])

    rows = stored.mapInArrow(run, "c bigint, n bigint, s array<bigint>")
    rows = rows.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i].cast("decimal(19,0)")) for i in range(dims))).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["c"]] = [int(x) // r["n"] for x in r["s"]]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, steps: int = 64, lead: int = 16, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of all kept vectors, and the centroids they were last assigned to.

    vectors (vec_id, embedding): kept are those of exactly dims components, none null, not finite or of LARGEST or more
    steps (their distances would not fit in 64 bits). The first centroids are the k kept vectors of the smallest
    sha256(salt:vec_id), of equal ids the one of smaller components first; fewer vectors are fewer centroids. Null ids are
    assigned and never chosen to begin; repeated rows are as many vectors; empty tables give no rows; other columns aren't
    read. Tasks add up their own vectors, so that the driver sees k rows of sums a round, and clusters of any size are a row
    for each task in the shuffle.
    """
    ints = quantised(vectors, dims, steps)
    seeds = ints.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in seeds], np.int64).reshape(-1, dims)
    kind = dict(ints.dtypes)["vec_id"]
    with small_batches(vectors.sparkSession):
        rotation = Rotation(*principal_axes(ints, dims), lead)
        if not len(centroids):
            return ints.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
        stored = scratch(rotated(ints, rotation, dims), "rotated")
        for _ in range(rounds):
            centroids = moved(stored, centroids, rotation)

    def run(batches):
        for batch in batches:
            _, best, distance = _near(batch, centroids, rotation)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = scratch(stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    discard(stored)
    return assigned, centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; sums that pass 64 bits are null."""
    assigned, centroids = centroid_clusters(vectors, **options)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = sum(sums.values()) if None not in sums.values() else None
    total = total if total is not None and total < 1 << 63 else None
    rows = [(c, sums.get(c), total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    own = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
