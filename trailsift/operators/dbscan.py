"""Exact distributed DBSCAN over standardised feature vectors (ML-2; JOIN-4, AGG-13, WIN-6/7).

Semantics (as the reference's sequential DBSCAN in lexsort scan order):
core = at least ``min_samples`` rows within ``eps`` (inclusive, self counted);
clusters = connected components of core points; a border point joins the
lowest-numbered cluster that has a core point within ``eps``; clusters are
numbered 0, 1, ... in scan order of their first core point, the scan order
being the lexicographic order of (f12, f11, ..., f00); the rest is noise (-1).

Plan (no per-row Python):

1. Collapse identical vectors (weight ``w``): copies never reach a join.
2. Standardise with weighted mean / population std of the collapsed table.
3. Sub-cells of side ``eps / sqrt(d)``: any two points of a sub-cell are
   neighbours, so a sub-cell of weight >= ``min_samples`` is all core and
   internally connected without emitting a single pair.
4. Candidate sub-cell pairs: those whose bounding boxes (of the points inside) are within
   eps, found by walking down a tree of size-bounded cells (``box_join``): no axis has to
   separate the data by itself, nothing is replicated. In 13 narrow dimensions without any
   structure, most cells of four and more boxes stay near each other; the join then compares
   about a quarter of all pairs of sub-cells (boxes and cells together).
5. Bounding boxes of the points in each sub-cell decide a (point, sub-cell) or
   (sub-cell, sub-cell) pair wholesale when the boxes are entirely within or
   beyond eps; only partly overlapping pairs go to vector pairs with the exact
   distance over all d axes: (a) for points of light sub-cells, to count
   neighbours and find core neighbours; (b) between core points, to connect
   sub-cells. Two heavy, tight sub-cells therefore connect with no vector pair.
6. Components of core sub-cells (large-star / small-star), numbered in scan
   order of their first core point (distributed dense index over the roots).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trailsift.operators.box_join import near_pairs, numbered
from trailsift.operators.components import connected_components, dense_index
from trailsift.operators.features import (FEATURES, SCALED, collapse, first_pass_metrics,
                                         scale_stats, scaled_columns)
from trailsift.session import materialize

# Defaults of the reference (fixed there): eps 1.5, min_samples 20.
DEFAULT_EPS = 1.5
DEFAULT_MIN_SAMPLES = 20


@dataclass
class DbscanResult:
    vectors: DataFrame     # f00..f12, w, z00..z12, core, cluster  (one row per distinct vector)
    stats: list[dict]      # standardisation row per feature


def _scan_key(cols: list[str]) -> Column:
    """Scan order of the sequential algorithm: lexicographic with the last feature first."""
    return F.struct(*[F.col(c).alias(f"k{i:02d}") for i, c in enumerate(reversed(cols))])


def _keep(df: DataFrame, cached: list) -> DataFrame:
    """Persist a deterministic intermediate that is read more than once (lineage stays short:
    it starts at a written table, so a lost executor recomputes only a few narrow steps)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    cached.append(df)
    return df


# The wide per-axis expressions are written as one SQL text each: a single call to
# the JVM instead of several per axis. Sums run left to right, squares are x * x.
def _dbl(x: float) -> str:
    """An exact DOUBLE literal."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _sq(e: str) -> str:
    return f"({e}) * ({e})"


def _sum_sql(terms: list[str]) -> str:
    return " + ".join(terms)


def _dist2(a: str, b: str, zcols: list[str]) -> Column:
    return F.expr(_sum_sql([_sq(f"{a}.{z} - {b}.{z}") for z in zcols]))


def _extent(units: DataFrame, gcols: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """How many sub-cells there are, and the smallest and largest cell number of each axis."""
    row = units.agg(F.count(F.lit(1)).alias("n"), *[F.min(g).alias(f"lo_{g}") for g in gcols],
                    *[F.max(g).alias(f"hi_{g}") for g in gcols]).first()
    return row["n"], [(row[f"lo_{g}"] or 0, row[f"hi_{g}"] or 0) for g in gcols]


def dbscan_vectors(features: DataFrame, eps: float = DEFAULT_EPS,
                   min_samples: int = DEFAULT_MIN_SAMPLES, cols: list[str] = FEATURES,
                   exact_counts: bool = False, extras: tuple[Column, ...] = ()) -> DbscanResult:
    """Cluster the rows of ``features`` (columns ``cols``); one output row per distinct vector.

    ``nbr_weight`` is the whole neighbour count of points of light sub-cells; points of heavy
    sub-cells are core whatever their count, so theirs is null unless ``exact_counts`` is set.
    ``extras`` are aggregates of the rows of a vector (named columns) that come out with it.
    """
    cached: list[DataFrame] = []
    try:
        return _clustered(features, eps, min_samples, cols, exact_counts, extras, cached)
    finally:
        for df in cached:
            df.unpersist()


def _clustered(features: DataFrame, eps: float, min_samples: int, cols: list[str], exact_counts: bool,
               extras: tuple[Column, ...], cached: list[DataFrame]) -> DbscanResult:
    d = len(cols)
    zcols = SCALED[:d] if d <= len(SCALED) else [f"z{i:02d}" for i in range(d)]
    gcols = [f"g{i:02d}" for i in range(d)]

    # One written table of distinct vectors: its ids are stable on every re-read.
    # The first pass of the standardisation statistics is observed on the collapsed
    # rows during the same write (final stage: applied once per partition); the
    # centred second pass reads the distinct vectors only.
    obs = Observation()
    observed = collapse(features, cols, extras).observe(obs, *first_pass_metrics(cols))
    vectors = materialize(observed.withColumn("vid", F.monotonically_increasing_id()),
                          "dbscan-collapse")
    try:
        first = obs.get
    except Py4JError:
        # No metrics when the optimiser proved the input empty and dropped the scan.
        first = None
    stats = scale_stats(vectors, cols, first=first)

    delta = eps / math.sqrt(d) * (1 - 1e-9)       # sub-cell side: diameter < eps

    scaled = vectors.select("vid", "w", *cols, *scaled_columns(stats, zcols))
    scaled = scaled.selectExpr("*", *[f"CAST(FLOOR({z} / {_dbl(delta)}) AS BIGINT) AS {g}"
                                      for z, g in zip(zcols, gcols)])
    # Sub-cell id = smallest vector id inside it: unique and deterministic.
    # The same aggregation keeps each sub-cell's bounding box (lo/hi per axis).
    lo = [f"lo{i:02d}" for i in range(d)]
    hi = [f"hi{i:02d}" for i in range(d)]
    units = _keep(scaled.groupBy(*gcols).agg(
        F.sum("w").alias("unit_w"), F.count(F.lit(1)).alias("n"), F.min("vid").alias("uid"),
        *[F.min(z).alias(l) for z, l in zip(zcols, lo)],
        *[F.max(z).alias(h) for z, h in zip(zcols, hi)]), cached)
    pts = _keep(scaled.join(units.select(*gcols, "uid", "unit_w"), gcols)
                .withColumn("skey", _scan_key(cols)), cached)

    # Bounding boxes of the points actually inside each sub-cell (a box per sub-cell:
    # lo/hi per axis). A point and a box, or two boxes, are decided wholesale when
    # the box distances are clearly within or beyond eps; only the rest goes to
    # vector pairs. Margins send near-eps cases to the exact path.
    within, beyond = eps * eps * (1 - 1e-9), eps * eps * (1 + 1e-9)

    # -- candidate pairs of distinct sub-cells: boxes within eps of each other --------------
    n_units, ranges = _extent(units, gcols)
    # Both are written: every level of the tree reads the boxes twice, and a cached plan would be part of each.
    placed = materialize(numbered(units.select("uid", *gcols, *lo, *hi), gcols, ranges, "uid"), "dbscan-boxes")
    half = materialize(near_pairs(placed, n_units, lo, hi, beyond, "uid"), "dbscan-pairs")
    unit_pairs = half.select(F.col("x").alias("ua"), F.col("y").alias("ub")).unionByName(
        half.select(F.col("y").alias("ua"), F.col("x").alias("ub")))

    def boxes(points: DataFrame) -> DataFrame:
        return points.groupBy("uid").agg(*[F.min(z).alias(l) for z, l in zip(zcols, lo)],
                                         *[F.max(z).alias(h) for z, h in zip(zcols, hi)])

    zero = _dbl(0.0)

    def point_box(p: str, b: str) -> tuple[Column, Column]:
        """Squared distance from a point to the nearest and to the farthest corner of a box."""
        near = [_sq(f"greatest({b}.{l} - {p}.{z}, {p}.{z} - {b}.{h}, {zero})")
                for z, l, h in zip(zcols, lo, hi)]
        far = [_sq(f"greatest({p}.{z} - {b}.{l}, {b}.{h} - {p}.{z})")
               for z, l, h in zip(zcols, lo, hi)]
        return F.expr(_sum_sql(near)), F.expr(_sum_sql(far))

    def box_box(a: str, b: str) -> tuple[Column, Column]:
        """Squared smallest and largest distance between the points of two boxes."""
        near = [_sq(f"greatest({b}.{l} - {a}.{h}, {a}.{l} - {b}.{h}, {zero})")
                for l, h in zip(lo, hi)]
        far = [_sq(f"greatest({b}.{h} - {a}.{l}, {a}.{h} - {b}.{l})") for l, h in zip(lo, hi)]
        return F.expr(_sum_sql(near)), F.expr(_sum_sql(far))

    # -- (a) neighbour weight of points in light sub-cells ---------------------------------
    p_cols = ["vid", "uid", "unit_w", "w", *zcols]
    counted = pts if exact_counts else pts.filter(F.col("unit_w") < min_samples)
    light = counted.select(*p_cols).alias("p")
    other = pts.select(*p_cols).alias("q")
    ubox = units.select("uid", "unit_w", *lo, *hi).alias("b")
    near, far = point_box("p", "b")
    to_boxes = _keep(
        light.join(unit_pairs, F.col("p.uid") == F.col("ua"))
        .join(ubox, F.col("b.uid") == F.col("ub"))
        .select(F.col("p.vid").alias("vid"), F.col("ub").alias("nuid"),
                F.col("b.unit_w").alias("nw"),
                F.when(far <= F.lit(within), F.lit("all"))
                .when(near > F.lit(beyond), F.lit("none")).otherwise(F.lit("some")).alias("fit"))
        .filter(F.col("fit") != "none"), cached)
    whole = to_boxes.filter(F.col("fit") == "all").select("vid", "nuid", "nw")
    some = to_boxes.filter(F.col("fit") == "some").select("vid", "nuid").alias("s")
    near_pts = _keep(
        some.join(light, F.col("p.vid") == F.col("s.vid"))
        .join(other, F.col("q.uid") == F.col("s.nuid"))
        .filter(_dist2("p", "q", zcols) <= F.lit(eps * eps))
        .select(F.col("p.vid").alias("vid"), F.col("q.vid").alias("nvid"),
                F.col("q.uid").alias("nuid"), F.col("q.w").alias("nw")), cached)
    counts = (whole.select("vid", "nw").unionByName(near_pts.select("vid", "nw"))
              .groupBy("vid").agg(F.sum("nw").alias("outside")))
    core = (pts.join(counts, "vid", "left")
            .withColumn("nbr_weight", F.col("unit_w") + F.coalesce("outside", F.lit(0)))
            .withColumn("core", F.col("nbr_weight") >= F.lit(min_samples)))
    core = _keep(core.select("vid", "uid", "w", "skey", "nbr_weight", "core", *cols, *zcols),
                 cached)

    # -- (b) connections between core sub-cells ----------------------------------------------
    core_pts = core.filter("core").select("vid", "uid", *zcols)
    cbox = boxes(core_pts)
    near, far = box_box("a", "b")
    box_pairs = _keep(
        unit_pairs.filter(F.col("ua") < F.col("ub"))
        .join(cbox.alias("a"), F.col("a.uid") == F.col("ua"))
        .join(cbox.alias("b"), F.col("b.uid") == F.col("ub"))
        .select("ua", "ub", F.when(far <= F.lit(within), F.lit("all"))
                .when(near > F.lit(beyond), F.lit("none")).otherwise(F.lit("some")).alias("fit"))
        .filter(F.col("fit") != "none"), cached)
    cp, cq = core_pts.alias("p"), core_pts.alias("q")
    checked = (box_pairs.filter(F.col("fit") == "some")
               .join(cp, F.col("p.uid") == F.col("ua"))
               .join(cq, F.col("q.uid") == F.col("ub"))
               .filter(_dist2("p", "q", zcols) <= F.lit(eps * eps))
               .select(F.col("ua").alias("x"), F.col("ub").alias("y")))
    core_edges = box_pairs.filter(F.col("fit") == "all").select(
        F.col("ua").alias("x"), F.col("ub").alias("y")).unionByName(checked)
    comp = connected_components(core_edges)
    core_units = core.filter("core").groupBy("uid").agg(F.min("skey").alias("ukey"))
    unit_root = (core_units.join(comp.withColumnRenamed("node", "uid"), "uid", "left")
                 .select("uid", "ukey", F.coalesce("root", "uid").alias("root")))
    roots = unit_root.groupBy("root").agg(F.min("ukey").alias("rkey"))
    ordered = dense_index(roots, ["rkey"], "cluster")
    unit_cluster = _keep(unit_root.join(ordered.select("root", "cluster"), "root")
                         .select("uid", F.col("cluster").cast("int").alias("cluster")), cached)

    # -- labels --------------------------------------------------------------------------
    # Border candidates: whole boxes within eps (their core points, if any, share the
    # box's cluster) and checked neighbours that are core.
    core_near = near_pts.join(core.filter("core").select(F.col("vid").alias("nvid")), "nvid",
                              "left_semi").select("vid", "nuid")
    border_near = (whole.select("vid", "nuid").unionByName(core_near)
                   .join(pts.filter(F.col("unit_w") < min_samples).select("vid"), "vid",
                         "left_semi")
                   .join(unit_cluster.withColumnRenamed("uid", "nuid"), "nuid")
                   .groupBy("vid").agg(F.min("cluster").alias("near_cluster")))
    labelled = (core.join(unit_cluster.withColumnRenamed("cluster", "own_cluster"), "uid", "left")
                .join(border_near, "vid", "left")
                .withColumn("cluster", F.when(F.col("core"), F.col("own_cluster")).otherwise(
                    F.coalesce(F.least("own_cluster", "near_cluster"), F.lit(-1)))
                    .cast("int")))
    if not exact_counts:  # a partial sum for heavy sub-cells: not a neighbour count
        heavy = units.filter(F.col("unit_w") >= min_samples).select("uid", F.lit(True).alias("heavy"))
        labelled = labelled.join(heavy, "uid", "left").withColumn(
            "nbr_weight", F.when(F.col("heavy").isNull(), F.col("nbr_weight")))
    carried = [c for c in vectors.columns if c not in (*cols, "w", "vid")]
    if carried:
        labelled = labelled.join(vectors.select("vid", *carried), "vid")
    out = materialize(labelled.select(*cols, "w", *zcols, "nbr_weight", "core", "cluster", *carried),
                      "dbscan-vectors")
    return DbscanResult(vectors=out, stats=stats)
