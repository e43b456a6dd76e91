import math
import random

import numpy as np
import pytest

from trailsift.llm import vector_links as vl

NAN = float("nan")


def brute(rows, threshold):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and usable(v)]
    links, parent = {}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x, la) in enumerate(good):
        for b, y, lb in good[k + 1:]:
            if la == lb and len(x) == len(y) and vl.exact_cosine(x, y) >= threshold:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return {i: (links.get(i, 0), find(i)) for i, _, _ in rows if i is not None}


@pytest.mark.parametrize("cell,piece,cells", [(2048, 2048, 200_000), (20, 16, 200_000), (20, 16, 0)])
def test_against_brute_force(spark, monkeypatch, cell, piece, cells):
    monkeypatch.setattr(vl, "CELL", cell)
    monkeypatch.setattr(vl, "SHARE", 8 * piece)
    monkeypatch.setattr(vl, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(vl, "PIECE", piece)
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2, 3):
        centres = rng.standard_normal((8, 6))
        for _ in range(90):
            v = centres[rng.integers(8)] + rng.standard_normal(6) * rng.choice([0.05, 0.3, 1.0])
            rows.append([float(x) for x in v])
    rows = [(i, v, 1 + i % 3 if i < 200 else 1) for i, v in enumerate(rows)]
    twin = rows[5][1]
    rows += [(1000 + i, twin, rows[5][2]) for i in range(40)]          # a hot vector
    rows += [(2000, [0.0] * 6, 1), (2001, None, 1), (2002, [], 1), (2003, [1.0, NAN, 0.0, 0.0, 0.0, 0.0], 1),
             (2004, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (2005, twin, None), (2006, twin[:5], 1),
             (2007, [3.0, 4.0], 9), (2008, [5.0, 0.0], 9), (2009, [0.93, math.sqrt(1 - 0.93 ** 2)], 9),
             (2010, [1.0, 0.0], 9), (2011, [-1.0, 0.0], 9)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vl.near_vectors(df, 0.93).collect()}
    assert got == brute(rows, 0.93)


def test_empty_and_null_ids(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vl.near_vectors(spark.createDataFrame([], kind)).collect() == []
    rows = vl.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], kind)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows} == {
        (None, 0, None, True), (1, 0, 1, True)}


def test_dense_group_costs_rows_by_its_size(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist(), "one") for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    coded = df.selectExpr("vec_id AS id", "label", "embedding AS vector").mapInArrow(
        vl._encode, "id long, label string, vector binary").selectExpr(
        "id AS node", "label", "16 AS size", "1L AS copies", "vector")
    found = vl.range_links(coded, 0.93).collect()
    assert len(found) < 5000                                   # and not the 1,124,250 links
    assert sum(r["n"] for r in found if r["y"] is None) == 1500 * 1499
    got = vl.near_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1499, 0)}


def test_many_labels_clashing_columns_and_repeated_ids(spark):
    rows = [(i, [1.0, float(i % 3)], f"l{i // 6}", "x", 7) for i in range(3000)] + [(0, [0.0, 1.0], "l0", "x", 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node string, place int")
    rows = vl.near_vectors(df, 0.999).collect()
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in rows if r["vec_id"] > 5}
    # Six vectors of a label, two of each direction.
    assert got == {(i, 1, i - 3 if i % 6 > 2 else i) for i in range(6, 3000)}
    # Id 0 stands for [1, 0], which vector 3 equals, and for [0, 1], which has no link.
    two = [r for r in rows if r["vec_id"] == 0]
    assert [(r["component_id"], r["kept"]) for r in two] == [(0, True)] * 2
