"""Pairs of boxes within a distance of each other, exactly, without comparing all of them.

Boxes are numbered along a Z-order curve of their cell numbers (one range sort) and consecutive
ones form cells of bounded size: ``SIZES`` boxes each, level above level up to one root. A cell's
box is the hull of its members, so members of two cells are never nearer to each other than the
cells' hulls. The join walks down from the pair (root, root): each level replaces the pairs left by the
pairs of their children (two equi-joins on the parent) and keeps those whose hulls are within the
distance in all dimensions at once. Nothing is replicated, no axis has to separate the data by
itself, and a cell never holds more than its size, however many boxes lie close together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.operators.components import dense_index

#: Boxes of a cell, level by level; further levels grow by ``FAN_OUT``. Small steps below, where hulls are
#: tight and few pairs are left; above them nearly all pairs of cells are left in spread data anyhow.
SIZES = (2, 4)
FAN_OUT = 64


def z_order(cells: Sequence[str], ranges: Sequence[tuple[int, int]]) -> list[Column]:
    """Sort keys of the Z-order curve over integer columns: their bits (from each smallest value), highest
    first, interleaved. One 64-bit key holds as many bits as fit; an axis takes part below its own highest bit."""
    bits = [(f"{c} - ({low}L)", (high - low).bit_length()) for c, (low, high) in zip(cells, ranges)]
    order = [f"(shiftright({e}, {t}) & 1L)" for t in reversed(range(max((n for _, n in bits), default=0)))
             for e, n in bits if t < n]
    keys = [order[i:i + 62] for i in range(0, len(order), 62)] or [["0L"]]
    return [F.expr(" | ".join(f"shiftleft({bit}, {len(key) - 1 - i})" for i, bit in enumerate(key))) for key in keys]


def numbered(boxes: DataFrame, cells: Sequence[str], ranges: Sequence[tuple[int, int]], unique: str) -> DataFrame:
    """``boxes`` with ``idx``, their dense number along the curve (ties by the column ``unique``)."""
    keys = {f"__z{i:03d}": key for i, key in enumerate(z_order(cells, ranges))}
    return dense_index(boxes.withColumns(keys), [*keys, unique], "idx").drop(*keys)


def levels(count: int) -> list[int]:
    """Cell sizes from single boxes up to the first that holds all ``count`` of them."""
    sizes = [1, *SIZES]
    while sizes[-1] < count:
        sizes.append(sizes[-1] * FAN_OUT)
    return sizes[:next(i for i, size in enumerate(sizes) if size >= count) + 1]


def hulls(boxes: DataFrame, size: int, parent_size: int, low: Sequence[str], high: Sequence[str],
          unique: str) -> DataFrame:
    """(node, parent, ``unique``, ``low``, ``high``): the cells of one level with the hulls of their members."""
    node = F.expr(f"idx div {size}L")
    if size == 1:
        found = boxes.select(node.alias("node"), unique, *low, *high)
    else:
        found = boxes.groupBy(node.alias("node")).agg(
            F.min(unique).alias(unique), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
    return found.withColumn("parent", F.expr(f"node div {parent_size // size}L"))


def square_gap(low: Sequence[str], high: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """Squared smallest distance between two boxes."""
    gaps = [f"greatest({b}.{lo} - {a}.{hi}, {a}.{lo} - {b}.{hi}, CAST(0 AS DOUBLE))" for lo, hi in zip(low, high)]
    return F.expr(" + ".join(f"({g}) * ({g})" for g in gaps))


def children(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of children ``a``, ``b`` of the node pairs (x, y), each unordered pair once."""
    return (pairs.join(nodes.alias("a"), F.col("x") == F.col("a.parent"))
            .join(nodes.alias("b"), F.col("y") == F.col("b.parent"))
            .filter(F.col("a.node") <= F.col("b.node")))


def near_pairs(boxes: DataFrame, count: int, low: Sequence[str], high: Sequence[str], limit: float,
               unique: str, seen: list[DataFrame] | None = None) -> DataFrame:
    """(x, y): ``unique`` values of all pairs of different ``boxes`` whose squared distance is at most ``limit``.

    ``boxes`` have ``idx`` from 0 to ``count`` - 1. Each pair comes once. ``seen`` collects the pairs that
    each level compares.
    """
    sizes = levels(count)
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("x"), F.col("id").alias("y"))
    for size, parent_size in reversed(list(zip(sizes, sizes[1:]))):
        compared = children(pairs, hulls(boxes, size, parent_size, low, high, unique))
        if size == 1:
            compared = compared.filter(F.col("a.node") < F.col("b.node"))
        if seen is not None:
            seen.append(compared.select("x", "y"))
        name = unique if size == 1 else "node"
        pairs = compared.filter(square_gap(low, high) <= F.lit(limit)).select(
            F.col(f"a.{name}").alias("x"), F.col(f"b.{name}").alias("y"))
    return pairs if len(sizes) > 1 else pairs.limit(0)
