"""Centroid clustering of integer vectors, exact, with geometric drift tightening.

A vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to each
other one. When centroids move, all vectors of a cluster lie in a sphere around its old centroid, and what the move of another
centroid can take from their distances to it is bounded in the plane through the sphere's centre and the two places of that
centroid (``loosened``): never more than its drift, and less where the move passes the sphere by. A vector whose upper bound stays
below all its lower bounds keeps its cluster unseen; then its own distance is made exact; the centroids that are still ambiguous are scanned exactly.

Distances are sums of squares of whole numbers; bounds are floats with a margin that covers their rounding, so clusters are those of a
full scan. A round is one pass over the vectors where they lie (written with their bounds, four bytes for each centroid) and one aggregate of a row per
cluster: only centroids travel, never vectors, and equal vectors or a huge cluster put no more on one task than on another.

Defined results: vectors that are null, of another length, or with null or non-finite components are not kept; a null id ranks as an
empty one and stays null; repeated rows are rows of their own (equal hashes rank by components); fewer vectors than clusters make
that many clusters; an empty cluster keeps its centroid; ties go to the smaller number; an empty table gives an empty one;
extra columns are not read. Components of 2**27 or more after scaling (squared distances beyond a long) raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components below this keep squared distances in a long.
LARGEST = 1 << 27
#: Part by which bounds are made wider than they are, far more than floats round.
MARGIN = 1e-12

_STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<float>, distance long, scans int"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the whole vectors, each component as floor(scale * component)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False))
            x = np.asarray(pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)  # null: nan
            good = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[good])
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component of {np.abs(x).max() / scale:g} or so: squared distances would not fit a long")
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), _lists(x)], names=["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).transform(in_tasks, whole, "vec_id long, x array<int>")


def _lists(x: np.ndarray, kind: type = np.int32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(kind).ravel()))


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((x - centre) ** 2).sum(axis=1)


def above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + MARGIN)


def below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - MARGIN)


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[a, b]: by how much the distance from any vector of cluster a to centroid b can have shrunk.

    A point seen from the middle of a centroid's two places under an angle phi to its move comes nearer by no more than
    move * cos(phi): points that come nearer by more lie inside a hyperbola whose asymptotes have that angle. Of a sphere the point
    with the smallest angle counts, in the plane of the sphere's centre and the move: the angle of the centre less that of the sphere's half width.
    A sphere that holds the middle leaves the full drift; so does a cluster's own centroid.
    """
    out = np.zeros((len(old), len(old)))
    for b in range(len(old)):
        step = (new[b] - old[b]).astype(np.float64)
        move = float(np.sqrt((step**2).sum()))
        if not move:
            continue
        for a in range(len(old)):
            seen = old[a] - (old[b] + new[b]) / 2.0
            far = float(np.sqrt((seen**2).sum()))
            out[a, b] = move
            if a != b and radius[a] < far:
                angle = np.arccos(np.clip(seen @ step / (far * move), -1.0, 1.0)) - np.arcsin(radius[a] / far)
                out[a, b] = min(move, move * max(0.0, float(np.cos(max(0.0, angle)))) + 1e-9 * move)
    return out * (1 + MARGIN)


def _first(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            all_ = np.stack([squares(x, c) for c in centres], axis=1)
            nearest = all_.argmin(axis=1)  # the smallest number of equals
            own = all_[np.arange(len(x)), nearest]
            yield _batch(batch, nearest, above(own), below(all_), own, np.full(len(x), len(centres)))

    return rows.transform(in_tasks, assign, _STATE)


def _next(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """``state`` after the centroids moved from ``old`` to ``new``."""
    drift = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + MARGIN)
    less = loosened(old, new, radius)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            cluster, upper, scans = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (2, 3, 6))
            lower = pc.list_flatten(batch.column(4)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
            upper += drift[cluster]
            lower -= less[cluster]
            others = np.arange(len(new)) != cluster[:, None]
            near = np.flatnonzero(((lower <= upper[:, None]) & others).any(axis=1))
            own = squares(x[near], new[cluster[near]])
            upper[near] = above(own)
            unsure = (lower[near] <= upper[near, None]) & others[near]
            known = np.full(unsure.shape, np.iinfo(np.int64).max)  # what isn't scanned is farther than the own one
            known[np.arange(len(near)), cluster[near]] = own
            for b in np.flatnonzero(unsure.any(axis=0)).tolist():
                rows = np.flatnonzero(unsure[:, b])
                known[rows, b] = squares(x[near[rows]], new[b])
            seen = unsure | ~others[near]
            lower[near] = np.where(seen, below(known), lower[near])
            scans[near] += unsure.sum(axis=1)
            cluster[near] = known.argmin(axis=1)
            upper[near] = above(known.min(axis=1)) if len(near) else upper[near]
            yield _batch(batch, cluster, upper, lower, squares(x, new[cluster]), scans)

    return state.transform(in_tasks, assign, _STATE)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)


def _batch(batch: pa.RecordBatch, cluster, upper, lower, distance, scans) -> pa.RecordBatch:
    lower = _lists(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), np.float32)
    own = [pa.array(np.asarray(v, kind)) for v, kind in ((cluster, np.int32), (upper, np.float64), (distance, np.int64), (scans, np.int32))]
    return pa.record_batch([batch.column(0), batch.column(1), own[0], own[1], lower, own[2], own[3]], names=["vec_id", "x", "cluster", "upper", "lower", "distance", "scans"])


def _moved(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids, and the radius of each cluster around its old one; a row per cluster comes to the driver."""
    sums = [F.sum(F.col("x")[k].cast("long")) for k in range(centres.shape[1])]
    new, radius = centres.copy(), np.zeros(len(centres))
    for cluster, n, far, *total in state.groupBy("cluster").agg(F.count(F.lit(1)), F.max("upper"), *sums).collect():
        new[cluster] = [s // n for s in total]
        radius[cluster] = far
    return new, radius


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, x, cluster, distance, scans`` per kept vector, and the centroids of the last assignment.

    Centroids start as the kept vectors with the smallest sha256 of ``seed:vec_id``. ``distance`` is squared; ``scans`` counts the centroids, its own
    one apart, that the vector was compared with, over ``rounds`` + 1 assignments (all in the first).
    """
    rows = written(kept(vectors, dimensions, scale), "centroid-vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(start.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()  # a row per cluster
    centres = np.array([r["x"] for r in found], np.int64).reshape(len(found), dimensions)
    if not len(centres):
        return rows.selectExpr("vec_id", "x", "0 cluster", "0L distance", "0 scans"), centres
    state = written(_first(rows, centres), "centroid-state")
    for _ in range(rounds):
        new, radius = _moved(state, centres)
        state = written(_next(state, centres, new, radius), "centroid-state")
        centres = new
    return state.select("vec_id", "x", "cluster", "distance", "scans"), centres


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns from ``clustered``, and ``scans``."""
    rows, centres = clustered(vectors)
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = rows.sparkSession.createDataFrame([(k, sums.get(k, 0), name) for k, name in enumerate(names)], "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256", "scans")
