"""Centroid clustering of vectors in whole numbers, with a filter in a rotated space.

Method
------
Components become integers floor(1024 x). The vectors are rotated onto the principal axes of all kept
vectors; of each, the leading coordinates and the norm of the rest are stored. As the rest of a vector and
of a centroid can't be nearer to each other than their norms differ, the squared distance of the leading
coordinates plus the squared difference of these norms is a lower bound of the squared distance. In each
round a vector is compared exactly with the centroid of the least bound, then with those whose bound
(less the rounding error of the rotation) isn't above that distance: integers decide, so the rotation
only saves work and can't change a result.

Vectors never move between tasks: a round reads the stored table, and only sums per centroid and component
are shuffled. The driver holds the centroids (k x dimension integers) and the rotation.

Edge cases
----------
Vectors of another length, and null vectors or ones with a null or non-finite component, give no row. Rows
that repeat an id are vectors of their own. A vector without an id is clustered, but starts a centroid only
after all others; vectors of equal hash start by their components. With fewer vectors than k there are fewer centroids; an
empty table gives an empty table. Ties go to the smaller number; an empty centroid stays as it is and has no
rows. Components whose integers exceed 2^26 in magnitude are compared as Python integers, without the filter; a
distance or inertia that a long can't hold is null. A double whose 1024-fold is no double counts as non-finite.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import materialize
from trailsift.session import literal_table

SCALE = 1024
#: Leading coordinates that are stored.
LEADING = 12
#: Integers up to this magnitude are compared in 64 bits.
PLAIN = 1 << 26
#: Sums are shuffled in digits of this many bits, so that they have no largest value.
DIGIT = 40
_LONG = 2 ** 63


def vectors_of(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x), still as doubles (exact: 1024 is a power of two)."""
    return np.floor(vectors * SCALE)


def squared_distance(x: np.ndarray, centroid: Sequence[int]) -> np.ndarray:
    """Exact squared distances of the whole-number rows ``x``: longs, or Python integers for large values."""
    if not len(x) or max(float(np.abs(x).max()), float(max(map(abs, centroid)))) <= PLAIN:
        return ((x.astype(np.int64) - np.array(centroid, np.int64)) ** 2).sum(axis=1)
    return np.array([sum((int(v) - c) ** 2 for v, c in zip(row, centroid)) for row in x], object)


class Rotation:
    """Principal axes around a centre: the coordinates to store, and bounds from them."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray):
        self.centre, self.axes = centre, axes

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest."""
        moved = x - self.centre
        lead = moved @ self.axes
        rest = (moved * moved).sum(axis=1) - (lead * lead).sum(axis=1)
        return lead, np.sqrt(np.maximum(rest, 0))


def fit_rotation(count: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Rotation:
    centre = sums / max(count, 1)
    spread = products / max(count, 1) - np.outer(centre, centre)
    if not np.isfinite(spread).all():  # values whose squares are no doubles: any axes will do
        return Rotation(np.zeros(len(sums)), np.eye(len(sums), leading))
    return Rotation(centre, np.linalg.eigh(spread)[1][:, ::-1][:, :leading])


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: Sequence[Sequence[int]],
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, exact squared distance) of each row of ``x``, and how many distances were computed."""
    centres = np.array([[float(c) for c in row] for row in centroids])
    if not len(x) or max(np.abs(x).max(), np.abs(centres).max()) > PLAIN:
        found = np.array([squared_distance(x, c) for c in centroids], object)
        best = found.argmin(axis=0) if len(x) else np.zeros(0, np.int64)
        return best, found[best, np.arange(len(x))], found.size
    centre_lead, centre_rest = rotation.project(centres)
    bound = (((lead[:, None, :] - centre_lead) ** 2).sum(axis=2) + (rest[:, None] - centre_rest) ** 2)
    # Rounding of coordinates and norms, far above what doubles lose.
    size = (lead * lead).sum(axis=1) + rest * rest
    slack = 1 + 1e-6 * (size[:, None] + (centre_lead * centre_lead).sum(axis=1) + centre_rest * centre_rest)
    bound -= slack
    best, distance = np.argmin(bound, axis=1), np.zeros(len(x), np.int64)
    for k in range(len(centroids)):
        at = np.flatnonzero(best == k)
        distance[at] = squared_distance(x[at], centroids[k])
    first, compared = best.copy(), len(x)
    for k in range(len(centroids)):
        at = np.flatnonzero((first != k) & (bound[:, k] <= distance))
        found = squared_distance(x[at], centroids[k])
        compared += len(at)
        nearer = (found < distance[at]) | ((found == distance[at]) & (k < best[at]))
        best[at[nearer]], distance[at[nearer]] = k, found[nearer]
    return best, distance, compared


def _rows(batches: Iterator[pa.RecordBatch], dimension: int):
    for batch in batches:
        if batch.num_rows:
            yield batch, whole(vectors_of(batch.column("vector"), dimension))


def _moments(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(dimension), np.zeros((dimension, dimension))
        for _, x in _rows(batches, dimension):
            count, sums, products = count + len(x), sums + x.sum(axis=0), products + x.T @ x
        values = np.concatenate([[count], sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "value"])
    return run


def _project(rotation: Rotation, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, dimension):
            lead, rest = rotation.project(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)],
                names=[*batch.schema.names, "lead", "rest"])
    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids, rotation: Rotation, dimension: int):
    leading = rotation.axes.shape[1]
    for batch, x in _rows(batches, dimension):
        lead, rest = vectors_of(batch.column("lead"), leading), batch.column("rest").to_numpy()
        yield batch, x, *nearest(x, lead, rest, centroids, rotation)[:2]


def _sums(centroids, rotation: Rotation, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums = [[0] * dimension for _ in centroids]
        for _, x, best, _ in _assigned(batches, centroids, rotation, dimension):
            plain = np.abs(x).max() <= PLAIN
            for k in np.unique(best):
                own = x[best == k]
                counts[k] += len(own)
                part = own.astype(np.int64).sum(axis=0).tolist() if plain else [
                    sum(map(int, column)) for column in own.T]
                sums[k] = [a + b for a, b in zip(sums[k], part)]
        rows = [(k, i, *digit) for k in range(len(counts)) if counts[k]
                for i, v in enumerate([counts[k], *sums[k]]) for digit in digits(v)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                         names=["cluster", "i", "place", "value"])
    return run


def digits(value: int) -> list[tuple[int, int]]:
    """(place, digit with the sign of ``value``): value = sum of digit * 2^(40 place)."""
    sign, rest, out = (1 if value >= 0 else -1), abs(value), []
    while rest or not out:
        out.append((len(out), sign * (rest & ((1 << DIGIT) - 1))))
        rest >>= DIGIT
    return out


def _final(centroids, rotation: Rotation, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance in _assigned(batches, centroids, rotation, dimension):
            fits = [int(d) if d < _LONG else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(fits, pa.int64())],
                                             names=["id", "cluster", "distance"])
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """(id, vector): vectors of the right length with finite components only."""
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(
        F.coalesce((F.size("vector") == dimension) & finite, F.lit(False)))


def start_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest sha256 of "seed:id", as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select("vector", digest.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k)
    return [[int(v) for v in whole(np.array(r["vector"], np.float64))] for r in first.collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimension: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding", leading: int = LEADING) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per kept vector."""
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col, dimension)
    centroids = start_centroids(kept, k, seed)
    found = kept.mapInArrow(_moments(dimension), "i long, value double").groupBy("i").agg(F.sum("value").alias("value"))
    moments = np.zeros(1 + dimension + dimension * dimension)
    for r in found.collect():  # one row per moment, whatever the number of vectors
        moments[r["i"]] = r["value"]
    rotation = fit_rotation(int(moments[0]), moments[1:dimension + 1],
                            moments[dimension + 1:].reshape(dimension, dimension), min(leading, dimension))
    id_type, vector_type = kept.schema["id"].dataType.simpleString(), kept.schema["vector"].dataType.simpleString()
    table = materialize(kept.mapInArrow(_project(rotation, dimension),
                                        f"id {id_type}, vector {vector_type}, lead array<double>, rest double"), "rotated")
    for _ in range(rounds if centroids else 0):
        sums = table.mapInArrow(_sums(centroids, rotation, dimension), "cluster int, i int, place int, value long")
        totals: dict[int, list[int]] = {}
        # k x (dimension + 1) sums, of one or two digits each unless components are huge
        for r in sums.groupBy("cluster", "i", "place").agg(F.sum("value").alias("value")).collect():
            totals.setdefault(r["cluster"], [0] * (dimension + 1))[r["i"]] += r["value"] << DIGIT * r["place"]
        centroids = [[totals[c][i + 1] // totals[c][0] for i in range(dimension)] if c in totals else old
                     for c, old in enumerate(centroids)]
    assigned = materialize(table.mapInArrow(_final(centroids, rotation, dimension),
                                            f"id {id_type}, cluster int, distance long"), "clustered")
    inertia = {r["cluster"]: int(r["value"]) if r["value"] is not None and r["held"] == r["n"] else None
               for r in assigned.groupBy("cluster").agg(
                   F.sum(F.col("distance").cast("decimal(38,0)")).alias("value"), F.count("distance").alias("held"),
                   F.count(F.lit(1)).alias("n")).collect()}  # at most k rows
    whole_inertia = None if None in inertia.values() else sum(inertia.values())

    def long_or_null(v):
        return v if v is not None and v < _LONG else None

    facts = literal_table(spark, [
        (c, long_or_null(inertia[c]), long_or_null(whole_inertia),
         hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # at most k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
