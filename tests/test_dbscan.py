"""Distributed DBSCAN (ML-2) against a sequential brute-force DBSCAN on small fixtures."""

import numpy as np
import pytest

from brute import sequential_dbscan, union_find_components
from trailsift.operators import box_join
from trailsift.operators.components import connected_components, dense_index
from trailsift.operators.dbscan import dbscan_vectors


def _frame(spark, X):
    d = X.shape[1]
    cols = [f"f{i:02d}" for i in range(d)]
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    schema = "rid LONG, " + ", ".join(f"{c} DOUBLE" for c in cols)
    return spark.createDataFrame(rows, schema), cols


def _labels(spark, X, eps, min_samples, **kw):
    df, cols = _frame(spark, X)
    res = dbscan_vectors(df.select(*cols), eps=eps, min_samples=min_samples, cols=cols, **kw)
    table = {tuple(r[c] for c in cols): r for r in res.vectors.collect()}
    return [table[tuple(float(v) for v in x)] for x in X]


def _blobs(seed, d, n_centres=3, per=40, noise=15, spread=0.25, dup=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, size=(n_centres, d))
    pts = [c + rng.normal(0, spread, size=(per, d)) for c in centres]
    pts.append(rng.normal(0, 3, size=(noise, d)))
    X = np.vstack(pts)
    X = np.round(X, 2)
    return np.vstack([X, X[rng.integers(0, len(X), dup)]])      # exact copies too


@pytest.mark.parametrize("seed,d,eps,min_samples", [
    (1, 2, 0.5, 5), (2, 3, 0.6, 8), (3, 13, 1.5, 20), (4, 5, 0.9, 10), (5, 2, 0.3, 4),
])
def test_matches_sequential_dbscan(spark, seed, d, eps, min_samples):
    X = _blobs(seed, d)
    expected, core, counts = sequential_dbscan(X, eps, min_samples)
    got = _labels(spark, X, eps, min_samples, exact_counts=True)
    assert [r.cluster for r in got] == list(expected)
    assert [r.core for r in got] == list(core)
    weights = [r.nbr_weight for r in got]
    assert weights == list(counts)


def test_dense_cell_all_core_without_pairs(spark):
    # 300 copies-ish inside one tiny region: a heavy sub-cell, everything core, one cluster.
    rng = np.random.default_rng(7)
    X = np.round(rng.normal(0, 0.001, size=(300, 3)), 5)
    X = np.vstack([X, [[5.0, 5.0, 5.0]]])
    expected, _, _ = sequential_dbscan(X, 0.5, 20)
    got = _labels(spark, X, 0.5, 20)
    assert [r.cluster for r in got] == list(expected)


def test_border_point_between_two_clusters(spark):
    # two dense groups on a line, a single point within eps of both: it joins cluster 0
    left = np.column_stack([np.linspace(0, 0.2, 25), np.zeros(25)])
    right = np.column_stack([np.linspace(2.0, 2.2, 25), np.zeros(25)])
    X = np.vstack([left, right, [[1.1, 0.0]], [[1.1, 5.0]], [[1.1, -5.0]]])
    expected, core, _ = sequential_dbscan(X, 0.45, 20)
    got = _labels(spark, X, 0.45, 20)
    assert [r.cluster for r in got] == list(expected)


def test_constant_columns_and_partitioning(spark):
    X = _blobs(11, 4)
    X[:, 2] = 7.0                                           # a constant column
    expected, _, _ = sequential_dbscan(X, 0.8, 6)
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = _labels(spark, X, 0.8, 6)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert [r.cluster for r in got] == list(expected)


def test_empty_input(spark):
    df, cols = _frame(spark, np.zeros((0, 3)))
    res = dbscan_vectors(df.select(*cols), cols=cols)
    assert res.vectors.count() == 0


def test_connected_components_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((60, 40), (200, 150), (30, 0)):
        edges = [tuple(map(int, rng.integers(0, n, 2))) for _ in range(m)]
        df = spark.createDataFrame(edges or [(0, 0)], "x LONG, y LONG")
        got = {r.node: r.root for r in connected_components(df).collect()}
        expected = union_find_components(n, edges)
        touched = {v for e in edges for v in e if e[0] != e[1]}
        assert got == {v: expected[v] for v in touched}


def test_dense_index_is_global_rank(spark):
    rng = np.random.default_rng(5)
    keys = rng.permutation(500).tolist()
    df = spark.createDataFrame([(int(k),) for k in keys], "k LONG")
    got = {r.k: r.idx for r in dense_index(df, ["k"], "idx", partitions=6).collect()}
    assert got == {k: k for k in range(500)}


def _near(spark, low, high, limit, side=0.4):
    """Pairs found by the tree join, checked against all pairs; how many each level compared."""
    n, d = low.shape
    gcols, lo, hi = ([f"{c}{i:02d}" for i in range(d)] for c in ("g", "lo", "hi"))
    cells = np.floor(low / side).astype(int)
    rows = [(1000 + i, *map(int, g), *map(float, a), *map(float, b)) for i, (g, a, b) in enumerate(zip(cells, low, high))]
    boxes = spark.createDataFrame(rows, "uid long, " + ", ".join(
        [f"{g} long" for g in gcols] + [f"{c} double" for c in [*lo, *hi]]))
    ranges = [(int(c.min()), int(c.max())) for c in cells.T]
    placed = box_join.numbered(boxes, gcols, ranges, "uid").persist()
    assert sorted(r.idx for r in placed.select("idx").collect()) == list(range(n))
    seen = []
    rows = [tuple(r) for r in box_join.near_pairs(placed, n, lo, hi, limit, "uid", seen).collect()]
    assert len({frozenset(r) for r in rows}) == len(rows)
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    want = {(i, j) for i, j in zip(*np.nonzero((gap ** 2).sum(axis=2) <= limit)) if i < j}
    assert {(min(r) - 1000, max(r) - 1000) for r in rows} == want
    compared = [s.count() for s in seen]
    placed.unpersist()
    return want, compared


def test_near_boxes_on_narrow_axes(spark):
    # 13 axes a standard deviation wide, no gaps: no single axis separates anything.
    rng = np.random.default_rng(8)
    low = rng.uniform(-3 ** .5, 3 ** .5, (2000, 13))
    _, compared = _near(spark, low, low, 2.25)
    pairs = 2000 * 1999 / 2
    assert compared[-1] < 0.1 * pairs and sum(compared) < 0.33 * pairs


def test_near_boxes_of_spread_and_gapped_data(spark):
    rng = np.random.default_rng(5)
    low = np.concatenate([rng.uniform(-120, 120, (1500, 4)), rng.uniform(0, 2.4, (1500, 9))], axis=1)
    want, compared = _near(spark, low, low + rng.uniform(0, 0.3, low.shape), 2.25)
    assert sum(compared) < 0.08 * 1500 * 1499 / 2  # a 16th of all pairs is what cells of four cost in the widest step
    centres = rng.integers(0, 2, (600, 5)) * 40.0
    low = centres + rng.uniform(0, 2, centres.shape)
    want, compared = _near(spark, low, low, 2.25)
    assert len(want) > 100 and sum(compared) < 0.12 * 600 * 599 / 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_near_boxes_few_and_equal(spark, n):
    low = np.repeat([[1.0, -2.0]], n, axis=0)
    want, _ = _near(spark, low, low, 0.0)
    assert len(want) == n * (n - 1) // 2


def test_one_axis_and_one_cell(spark):
    low = np.arange(300.0)[:, None]
    want, compared = _near(spark, low, low + 0.25, 1.0)
    assert len(want) == 299 and sum(compared) < 0.1 * 300 * 299 / 2


def test_levels_end_in_one_root():
    for n in (1, 2, 3, 4, 5, 256, 257, 10 ** 9):
        sizes = box_join.levels(n)
        assert sizes[0] == 1 and sizes[-1] >= n and all(b % a == 0 for a, b in zip(sizes, sizes[1:]))
        assert len(sizes) == 1 or sizes[-2] < n
