"""Connected components and distributed ordinal numbering.

``connected_components`` is the large-star / small-star algorithm (Kiveris et
al., "Connected Components in MapReduce and Beyond", SoCC 2014): every round is
a few joins and aggregations over the edge table, which is written as a table in the
session's checkpoint folder so lineage stays short and a lost executor only
re-runs the current round. It converges in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(
        edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
    mins = both.groupBy("u").agg(F.min("v").alias("mv")).select(
        "u", F.least("mv", "u").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(mins, "u")
            .select(F.col("v").alias("x"), F.col("m").alias("y")))


def _small_star(edges: DataFrame) -> DataFrame:
    directed = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    mins = directed.groupBy("u").agg(F.min("v").alias("m"))
    linked = directed.join(mins, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    own = mins.select(F.col("u").alias("x"), F.col("m").alias("y"))
    return linked.unionByName(own).filter(F.col("x") != F.col("y")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every node has at most one smaller neighbour and no node with a smaller
    neighbour has a larger one: each component is a star centred on its minimum.

    One aggregation over the edge table (both endpoints tagged), one small action.
    """
    roles = edges.select(F.greatest("x", "y").alias("node"), F.lit(1).alias("up"),
                         F.lit(0).alias("down")).unionByName(
        edges.select(F.least("x", "y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    bad = per_node.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Map every node that has an edge to the smallest node id of its component.

    ``edges`` has long columns ``x``, ``y`` (undirected, self loops ignored).
    Returns (node, root). Nodes without edges are not returned. One round =
    large-star then small-star, written once; the loop stops as soon as the edge
    table is a forest of stars centred on each component's minimum.
    """
    current = materialize(edges.select(F.col("x").cast("long"), F.col("y").cast("long"))
                          .filter(F.col("x") != F.col("y"))
                          .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
                          .distinct(), "cc-edges")
    rounds = 0
    while not _is_star_forest(current):
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("connected components did not converge")
        current = materialize(_small_star(_large_star(current)), "cc-edges")
    directed = current.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("root"))
    roots = directed.select(F.col("root").alias("node"), "root").distinct()
    return directed.unionByName(roots)


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order (keys unique).

    Distributed: range-partition and sort, count rows per partition, then number rows
    inside each partition plus the partition's offset. Only the counts (one row per
    partition) pass through a single task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order_cols)
                         .withColumn("__pid", F.spark_partition_id()))
    # Offset of each partition = rows in the partitions before it: one small row per partition.
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
               .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    w = Window.partitionBy("__pid").orderBy(*order_cols)
    return (ranged.withColumn(name, F.row_number().over(w) - 1).join(offsets, "__pid")
            .withColumn(name, F.col(name) + F.col("__before")).drop("__pid", "__before"))
