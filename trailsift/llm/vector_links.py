"""Embedding near-dedup: an exact metric range join over pivot cells.

Method
------
Unit vectors whose cosine is at least t lie within r = sqrt(2 - 2t) of each other. Within a
label, pivots are chosen among its vectors by hash, and a vector belongs to the cell of its nearest
pivot. A vector y within r of an x of another cell q is, by the triangle inequality, no
farther from the hyperplane between its own pivot p and q than r:
d(y, q)**2 - d(y, p)**2 <= 2 * r * d(p, q). Vectors that meet this bound are replicated to cell q, so
every pair is found in the cell of its smaller id, and cells join independently.

Equal vectors of a label are one node with a count. A cell's owners and guests come in pieces
of at most ``PIECE`` rows; every pair of pieces is a group of its own, so no cell, label or
vector gathers unboundedly. Pieces are compared by matrix products in double precision, and
pairs near the threshold once more by exactly rounded sums. A pair of pieces returns how many links
each node has there and a spanning forest of them, so that a dense group costs rows by its
size, not by its pairs. Vectors without clusters are
replicated to most cells (distances concentrate in many dimensions): the join then costs what
comparing all vectors of a label costs, and stays exact.

Edge cases
----------
Null, empty, zero vectors and vectors with null or non-finite components, and null labels,
link with nothing: n_links 0, a component of their own, kept. Vectors of different lengths
never link. Null ids are not linked and are kept. Rows that repeat an id count as further
vectors of that id. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import materialize
from trailsift.operators.components import connected_components

#: Vectors a cell is meant to own, pivots of a label at most, rows of a piece, nodes of a label dealt to cells at a time.
CELL, MAX_PIVOTS, PIECE, SHARE = 2048, 256, 2048, 16_384
#: The sizes of more cells than this are joined by shuffle instead of broadcast.
BROADCAST_CELLS = 200_000
#: Cosines this close to the threshold are computed again with exactly rounded sums.
DOUBT = 1e-9


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _matrix(column) -> np.ndarray:
    """Rows of equal-length binary vectors of doubles."""
    return np.stack([np.frombuffer(x, "<f8") for x in column])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A usable vector as the bytes of its doubles, others as null."""
    for batch in batches:
        out = []
        for vector in batch.column("vector").to_pylist():
            usable = vector is not None and len(vector) and None not in vector
            values = np.array(vector, "<f8") if usable else np.zeros(1)
            values = values + 0.0  # -0.0 is 0.0
            fine = np.isfinite(values).all() and values.any()
            out.append(values.tobytes() if fine else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label")), pa.array(out, pa.binary())],
                                         names=["id", "label", "vector"])


def _dealer(radius: float):
    """Each node's own cell, and the cells it is a guest of: a share of a label's nodes, with all its pivots."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pivots, nodes = rows[rows["pivot"]].sort_values(["place", "vector"]), rows[~rows["pivot"]]
        # A label whose sample came out empty has one pivot: everything is one cell.
        p = _matrix(pivots["vector"]) if len(pivots) else np.eye(1, int(rows["size"].iloc[0]))
        p = p / np.linalg.norm(p, axis=1, keepdims=True)
        between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
        parts = []
        for start in range(0, len(nodes), PIECE):
            piece = nodes.iloc[start:start + PIECE]
            x = _matrix(piece["vector"])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            square = np.maximum(2 - 2 * (x @ p.T), 0)
            own = square.argmin(axis=1)
            # 1e-9: rounding must never lose a guest.
            guest = square - square[np.arange(len(x)), own][:, None] <= 2 * radius * between[own] + 1e-9
            at, cell = np.nonzero(guest)
            parts.append(piece.iloc[at][["label", "size", "node", "copies", "vector"]].assign(
                cell=cell.astype(np.int32), owner=own[at] == cell))
        names = ["label", "size", "cell", "owner", "node", "copies", "vector"]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)
    return run


def _forest(near: np.ndarray) -> np.ndarray:
    """A spanning forest of a symmetric matrix of links, as rows (from, to): every node is visited once."""
    new, out = np.ones(len(near), bool), [np.empty((0, 2), np.int64)]
    for start in np.flatnonzero(near.any(axis=1)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & new)
            new[found] = False
            todo.extend(found)
            out.append(np.column_stack([np.full(len(found), at), found]))
    return np.concatenate(out)


def _linker(threshold: float):
    """One pair of pieces, owners of a cell against its owners and guests: the links each of their nodes has here
    (y null, n further vectors), and a spanning forest of the links (n null)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owners, others = rows[rows["left"]], rows[~rows["left"]]
        if not len(owners) or not len(others):
            return pd.DataFrame({"x": [], "y": [], "n": []}).astype("Int64")
        raw_a, raw_b = _matrix(owners["vector"]), _matrix(others["vector"])
        a = raw_a / np.linalg.norm(raw_a, axis=1, keepdims=True)
        b = raw_b / np.linalg.norm(raw_b, axis=1, keepdims=True)
        ids_a, ids_b = owners["node"].to_numpy(), others["node"].to_numpy()
        cosine = a @ b.T
        # A pair of two owners is seen from both sides, once; a guest always meets an owner, and the
        # pair is counted in the cell that owns the smaller id.
        linked = (cosine >= threshold - DOUBT) & (ids_a[:, None] < ids_b[None, :])
        for s, t in zip(*np.nonzero(linked & (cosine <= threshold + DOUBT))):
            linked[s, t] = exact_cosine(raw_a[s], raw_b[t]) >= threshold
        copies_a, copies_b = owners["copies"].to_numpy(), others["copies"].to_numpy()
        of_a, of_b = linked @ copies_b, linked.T @ copies_a
        has_a, has_b = of_a > 0, of_b > 0
        # A node that is on both sides is one row of the matrix.
        ids, row = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        near = np.zeros((len(ids), len(ids)), bool)
        i, j = np.nonzero(linked)
        i, j = row[i], row[len(ids_a) + j]
        near[i, j] = near[j, i] = True
        tree = np.sort(ids[_forest(near)], axis=1)
        counted = np.full(int(has_a.sum() + has_b.sum()), None)
        return pd.DataFrame({
            "x": pd.array(np.concatenate([ids_a[has_a], ids_b[has_b], tree[:, 0]]), "Int64"),
            "y": pd.array(np.concatenate([counted, tree[:, 1]]), "Int64"),
            "n": pd.array(np.concatenate([of_a[has_a], of_b[has_b], np.full(len(tree), None)]), "Int64")})
    return run


def range_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(x, y, n) for nodes of a label with cosine >= threshold: with y null, x has n further vectors as links (in
    one of several rows of x); with n null, x and y (x < y) link, and these links connect all that links connect.

    ``nodes`` has node, label (text), size, vector (bytes), copies. The rows grow with the nodes and the cells
    they meet in, not with the number of links.
    """
    groups = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = materialize(groups.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(MAX_PIVOTS), F.ceil(
        F.col("n") / CELL)))).withColumn("share", F.least(F.lit(1.0), (F.col("k") * 4 + 16) / F.col("n"))).withColumn(
        "shares", F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE)).cast("int")), "vectors-labels")
    # Pivots: a few nodes of each label by hash, at most MAX_PIVOTS of them.
    place = F.xxhash64("node", F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1))
    placed = nodes.join(wanted, ["label", "size"]).withColumn("place", place)
    pivots = (placed.filter(F.col("place") / F.lit(float(1 << 40)) <= F.col("share"))
              .groupBy("label", "size", "k", "shares").agg(F.sort_array(F.collect_list(F.struct(
                  "place", "vector"))).alias("found"))
              .select("label", "size", "shares", F.explode(F.slice("found", F.lit(1), F.col("k").cast("int"))).alias("p"))
              .select("label", "size", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("dealt"),
                      F.lit(True).alias("pivot"), "p.place", F.lit(None).cast("long").alias("node"),
                      F.lit(None).cast("long").alias("copies"), "p.vector"))
    members = placed.select("label", "size", F.pmod(F.xxhash64("node", F.lit(7)), F.col("shares")).cast("int").alias("dealt"),
                            F.lit(False).alias("pivot"), "place", "node", "copies", "vector")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    dealt = materialize(members.unionByName(pivots).groupBy("label", "size", "dealt").applyInPandas(
        _dealer(radius), "label string, size int, cell int, owner boolean, node long, copies long, "
        "vector binary"), "vectors-cells")
    sizes = materialize(dealt.groupBy("label", "size", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("owner") / PIECE)).cast("int").alias("owner_pieces"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PIECE)).cast("int").alias("all_pieces")), "vectors-sizes")
    # Beyond the checked number of cells a shuffle join, whose hot cells Spark splits.
    rows = dealt.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes, ["label", "size", "cell"])
    key = F.xxhash64("node", F.lit(5))
    left = rows.filter("owner").select(
        "*", F.pmod(key, F.col("owner_pieces")).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), F.col("all_pieces") - 1)).alias("b"), F.lit(True).alias("left"))
    right = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("owner_pieces") - 1)).alias("a"),
        F.pmod(key, F.col("all_pieces")).cast("int").alias("b"), F.lit(False).alias("left"))
    columns = ["label", "size", "cell", "a", "b", "left", "node", "copies", "vector"]
    return left.select(columns).unionByName(right.select(columns)).groupBy(
        "label", "size", "cell", "a", "b").applyInPandas(_linker(threshold), "x long, y long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per vector."""
    rows = materialize(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vector"))
        .mapInArrow(_encode, "id long, label string, vector binary"), "vectors")
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    nodes = materialize(usable.groupBy("label", "vector").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", (F.length("vector") / 8).cast("int")), "vectors-nodes")
    links = materialize(range_links(nodes, threshold), "vectors-links")
    degree = links.filter(F.col("y").isNull()).groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(links.filter(F.col("y").isNotNull()).select("x", "y"))
    found = nodes.join(degree, "node", "left").join(roots, "node", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"))
    return rows.join(found, ["label", "vector"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNull(), F.lit(0)).otherwise(
            F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
