"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from trailsift.llm import centroids as C

SCHEMA = "vec_id long, embedding array<{}>, label int, vector int, rest int"


def plain(rows, k, rounds, dimension, seed=3):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()
                                                     if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    found, out = assign(), []
    for (i, _), (d, n) in zip(kept, found):
        sums = sum(e for e, m in found if m == n), sum(e for e, _ in found)
        out.append((i, n, d, *sums, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()))
    return [tuple(None if isinstance(x, int) and x >= 2 ** 63 else x for x in row) for row in out]


def key(rows):
    return sorted(rows, key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA.format(kind)).repartition(4)


def got(df, **how):
    return key(tuple(r) for r in C.cluster(df, **how).collect())


def vectors(n, dimension, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dimension)] for _ in range(5)]
    return [(i, [float(np.float32(rng.gauss(c, 0.1 * spread))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("k,rounds,dimension,leading", [(8, 10, 8, 3), (3, 2, 5, 12), (8, 0, 4, 1), (1, 3, 3, 2)])
def test_equals_plain_version(spark, k, rounds, dimension, leading):
    rows = vectors(150, dimension, k)
    assert got(frame(spark, rows), k=k, rounds=rounds, dimension=dimension, leading=leading) == key(
        plain(rows, k, rounds, dimension))


def test_awkward_vectors(spark):
    rows = vectors(30, 4, 1) + [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 0.0, 0.0]),
                                (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [0.0] * 4),
                                (None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [rows[0], rows[0], (107, rows[1][1])]
    want = key(plain(rows, 8, 4, 4))
    assert got(frame(spark, rows), rounds=4, dimension=4) == want and len(want) == 36
    assert got(frame(spark, rows[:2]), rounds=4, dimension=4) == key(plain(rows[:2], 8, 4, 4))  # fewer than k
    assert got(frame(spark, []), dimension=4) == [] == got(frame(spark, [(1, None)]), dimension=4)


def test_ties_and_empty_clusters(spark):
    # Equal vectors start several centroids: all go to the smallest number, the others stay empty and in place.
    rows = [(i, [0.5, -0.5]) for i in range(20)] + [(20 + i, [float(i % 3), 1.0]) for i in range(9)]
    assert got(frame(spark, rows), k=8, rounds=3, dimension=2) == key(plain(rows, 8, 3, 2))


def test_large_components(spark):
    rows = vectors(20, 3, 2, spread=1e6) + [(50, [3e38, -3e38, 0.0]), (51, [1e20, 1.0, 1.0])]
    assert got(frame(spark, rows, "double"), k=4, rounds=3, dimension=3) == key(plain(rows, 4, 3, 3))
    rows += [(52, [1e307, 0.0, 0.0])]  # 1024 times that is no double: no row
    assert all(r[0] != 52 for r in got(frame(spark, rows, "double"), k=4, rounds=3, dimension=3))


def test_filter_spares_comparisons_and_changes_nothing():
    rng = np.random.default_rng(1)
    x = C.whole(rng.normal(size=(2000, 16)) * np.linspace(3, 0.1, 16))
    rotation = C.fit_rotation(len(x), x.sum(axis=0), x.T @ x, 6)
    centres = [[int(v) for v in row] for row in x[:8]]
    best, distance, compared = C.nearest(x, *rotation.project(x), centres, rotation)
    every = np.array([C.squared_distance(x, c) for c in centres])
    assert (best == every.argmin(axis=0)).all() and (distance == every.min(axis=0)).all()
    assert compared < 0.6 * every.size


def test_digits():
    for value in (0, 5, -5, 2 ** 40, -2 ** 81 + 3, 10 ** 50):
        assert sum(d << 40 * place for place, d in C.digits(value)) == value
