"""Source divergence audit: which sources of a language differ from each other, and by which terms.

Method
------
Terms are runs of letters a-z (A-Z lower-cased) and code points from U+0080 on. Each language keeps the
terms that stand in at least three of its documents; its groups (sources) and its kept terms are the rows
and columns of a count matrix. A group gives a term p = 1 + floor(10^9 (count + 1) / (N + V)), and a pair of
groups is priced by the sum of floor((p - q)^2 / q) over all kept terms.

The matrix is stored as K-squared quadtrees, one for each tile of 64 groups and 1,024 terms (terms are
numbered from frequent to rare, so that zeros lie together). A quadrant without a count is uniform: each of
its cells has the group's smallest p, so all-zero quadrants are priced analytically, from the number of
terms and from a histogram of each group's counts. Where two trees both have nonzero quadrants over the same
terms they are traversed jointly, for all group pairs of two tiles at once, down to leaves of 16 terms; those
add what the analytic price lacks. All of it is integer arithmetic, so the result doesn't depend on the order.

Counting runs in the tasks that read the text (bounded tables, written out when full); what is shuffled
are (language, source, term) counts, tiles of bounded size and price sums. Groups are rows of a tile,
so a source with a third of all rows is no larger a task than another.

Edge cases
----------
Null text, language and source are read as ''. Documents without a term still make their group occur.
Every row is a document: repeated rows count again, null ids don't matter. A language without kept terms has
V = 0: its pairs have value 0 and it has no term rows. A group alone in its language has no pair rows. An
empty table gives an empty table. Long texts are split into terms some megabytes at a time. Equal values are
ranked by item. Other columns are not read. Sums are exact while they fit a long.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.llm.common import materialize
from trailsift.operators.components import dense_index

LEAST_DOCS = 3
TOP_TERMS = 200
#: A tile has 2^TILE_BITS rows and 2^TILE_BITS leaves of 2^LEAF_BITS terms.
TILE_BITS, LEAF_BITS = 6, 4
#: Distinct (group, term) entries a counting task holds before it writes them out, and bytes split at once.
HELD_TERMS, HELD_BYTES = 300_000, 1 << 22

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(data: bytes, size: int = HELD_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, as lists from about ``size`` bytes each."""
    clean, at = data.translate(_TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + size)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = defaultdict(Counter), defaultdict(Counter)

    def written() -> Iterator[pa.RecordBatch]:
        for group, terms in total.items():
            found = docs[group]
            names = [None, *terms]  # the group itself occurs, with or without terms
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]] * len(names), pa.string()), pa.array([group[1]] * len(names), pa.string()),
                 pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *terms.values()], pa.int64()),
                 pa.array([0, *(found[t] for t in terms)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        total.clear()
        docs.clear()

    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            counts, seen = total[lang, source], set()
            held -= len(counts)
            for terms in pieces(text.as_py()):
                counts.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
            held += len(counts)
            if held > HELD_TERMS:
                yield from written()
                held = 0
    yield from written()


def share(count: Column, mass: Column) -> Column:
    """1 + floor(10^9 (count + 1) / mass) for count < mass, exactly: long division by thousands."""
    rest = count + F.lit(1).cast("long")
    value = F.call_function("div", rest, mass)
    for _ in range(3):
        step = (rest % mass) * 1000
        value = value * 1000 + F.call_function("div", step, mass)
        rest = step
    return value + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def quadtree(occupied: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the nonzero quadrants, from the root (1 x 1) to the leaves (``occupied``, a square)."""
    levels = [occupied]
    while len(levels[0]) > 1:
        n = len(levels[0]) // 2
        levels.insert(0, levels[0].reshape(n, 2, n, 2).any(axis=(1, 3)))
    return levels


def joint_leaves(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows of a, rows of b, leaf column): the leaves that are nonzero in both trees, column by column.

    Both trees are walked together from the root; a quadrant pair with an all-zero side goes no deeper.
    The walk is depth first over the columns, so that the pairs held at once belong to few columns.
    """
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, 0)] if a[0][0, 0] and b[0][0, 0] else []
    while stack:
        level, x, y, column = stack.pop()
        if level == len(a) - 1:
            yield x, y, column
            continue
        for child in (2 * column, 2 * column + 1):
            cx = np.repeat(2 * x, 4) + np.tile([0, 0, 1, 1], len(x))
            cy = np.repeat(2 * y, 4) + np.tile([0, 1, 0, 1], len(y))
            kept = a[level + 1][cx, child] & b[level + 1][cy, child]
            if kept.any():
                stack.append((level + 1, cx[kept], cy[kept], child))


class Tile:
    """One tile: the quadtree of its leaves, and each leaf's values (the row's smallest p where no count is)."""

    def __init__(self, row: np.ndarray, column: np.ndarray, p: np.ndarray, least: np.ndarray,
                 tile_bits: int, leaf_bits: int):
        side, width = 1 << tile_bits, 1 << leaf_bits
        occupied = np.zeros((side, side), bool)
        occupied[row, column >> leaf_bits] = True
        self.levels = quadtree(occupied)
        self.least = np.ones(side, np.int64)
        self.least[row] = least
        at_row, at_leaf = np.nonzero(occupied)
        self.number = np.zeros((side, side), np.int64)
        self.number[at_row, at_leaf] = np.arange(len(at_row))
        self.values = np.repeat(self.least[at_row], width).reshape(-1, width)
        self.values[self.number[row, column >> leaf_bits], column & (width - 1)] = p


def corrections(a: Tile, b: Tile) -> np.ndarray:
    """For rows x of a and y of b: the sum over the terms with counts in both of
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), which the analytic price lacks (other terms add nothing)."""
    out = np.zeros((len(a.least), len(b.least)), np.int64)

    def f(p, q):
        return (p - q) * (p - q) // q

    for x, y, column in joint_leaves(a.levels, b.levels):
        p, q = a.values[a.number[x, column]], b.values[b.number[y, column]]
        p0, q0 = a.least[x][:, None], b.least[y][:, None]
        out[x, y] += (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).sum(axis=1)
    return out


def _joint(tile_bits: int, leaf_bits: int):
    def run(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        row, column, p, least = (table.column(c).to_numpy() for c in ("row", "column", "p", "least"))
        side = (1 << tile_bits) - 1

        def tile(number: int) -> Tile:
            own = row >> tile_bits == number
            return Tile(row[own] & side, column[own] & ((1 << tile_bits + leaf_bits) - 1), p[own], least[own],
                        tile_bits, leaf_bits)

        first = tile(i)
        second = first if i == j else tile(j)
        parts = [(i, j, corrections(first, second))]
        if i != j:
            parts.append((j, i, corrections(second, first)))
        out = []
        for x, y, value in parts:
            at = np.nonzero(value)
            out.append(pa.table({"lang": pa.array([lang] * len(at[0]), pa.string()),
                                 "a": pa.array(at[0] + (x << tile_bits), pa.int64()),
                                 "b": pa.array(at[1] + (y << tile_bits), pa.int64()),
                                 "value": pa.array(value[at], pa.int64())}))
        return pa.concat_tables(out)
    return run


def count_matrix(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, cells). groups: (lang, source, row, mass, least, terms, lang_mass), one row per group; ``mass`` is
    N + V, ``least`` the p of a term without a count, ``terms`` V. cells: (lang, source, row, term, column, n, total,
    p, least, q), one row per group and kept term with a count; q is the language's p."""
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # The tasks have added up their documents' counts: dealing them by key first spares Spark a second combining.
    counts = materialize(
        slim.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    kept = (counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
            .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
            .select("lang", "term", "total", (-F.col("total")).alias("__order")))
    kept = dense_index(kept, ["lang", "__order", "term"], "column").drop("__order")
    cells = materialize(counts.filter(F.col("term").isNotNull()).select("lang", "source", "term", "n")
                        .join(kept, ["lang", "term"]), "audit-cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("__n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("__total"))
    mass = F.coalesce("__n", F.lit(0).cast("long")) + F.col("terms")
    groups = (counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
              .join(sizes, "lang", "left")
              .withColumn("row", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
              .select("lang", "source", "row", mass.alias("mass"), F.coalesce("terms", F.lit(0)).alias("terms"),
                      (F.col("__total") + F.col("terms")).alias("lang_mass")))
    zero = F.lit(0).cast("long")
    groups = materialize(groups.withColumn("least", F.when(F.col("terms") > 0, share(zero, F.col("mass")))),
                         "audit-groups")
    cells = (cells.join(groups.select("lang", "source", "row", "mass", "least", "lang_mass"), ["lang", "source"])
             .withColumns({"p": share(F.col("n"), F.col("mass")), "q": share(F.col("total"), F.col("lang_mass"))})
             .drop("mass", "lang_mass"))
    return groups, cells


def pair_values(groups: DataFrame, cells: DataFrame, tile_bits: int = TILE_BITS,
                leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(lang, a, b, value): the price of every ordered pair of different groups of a language (row numbers)."""
    a = groups.filter(F.col("terms") > 0).select("lang", F.col("row").alias("a"), F.col("least").alias("p0"), "terms")
    b = groups.select("lang", F.col("row").alias("b"), F.col("least").alias("q0"))
    zero = a.join(b, "lang").filter(F.col("a") != F.col("b")).select(
        "lang", "a", "b", (F.col("terms") * price(F.col("p0"), F.col("q0"))).alias("value"))
    # Uniform quadrants against counts: each group's histogram of p, once for every smallest value of the others.
    counted = cells.groupBy("lang", "row", "p").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("own"))
    right = (counted.join(a, "lang").filter(F.col("a") != F.col("row")).select(
        "lang", "a", F.col("row").alias("b"),
        (F.col("n") * (price(F.col("p0"), F.col("p")) - price(F.col("p0"), F.col("own")))).alias("value")))
    left = (counted.join(b, "lang").filter(F.col("b") != F.col("row")).select(
        "lang", F.col("row").alias("a"), "b",
        (F.col("n") * (price(F.col("p"), F.col("q0")) - price(F.col("own"), F.col("q0")))).alias("value")))
    # Counts against counts: tiles over the same terms meet, each pair of tiles once.
    placed = cells.select("lang", "row", "column", "p", "least",
                          F.shiftright("column", tile_bits + leaf_bits).alias("block"),
                          F.shiftright("row", tile_bits).alias("tile"))
    others = placed.select("lang", "block", F.col("tile").alias("other")).distinct()
    routed = placed.join(others, ["lang", "block"]).select(
        "lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
        "row", "column", "p", "least")
    joint = routed.groupBy("lang", "block", "i", "j").applyInArrow(
        _joint(tile_bits, leaf_bits), "lang string, a long, b long, value long").filter(F.col("a") != F.col("b"))
    return (zero.unionByName(right).unionByName(left).unionByName(joint)
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, tile_bits: int = TILE_BITS,
          leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): the sources and the terms that set each group apart."""
    groups, cells = count_matrix(docs, text_col, lang_col, source_col, least_docs)
    names = groups.select("lang", "row", "source")
    # All ordered pairs come from the groups themselves, so that languages without terms keep theirs.
    pairs = (names.select("lang", F.col("row").alias("a"), "source")
             .join(names.select("lang", F.col("row").alias("b"), F.col("source").alias("item")), "lang")
             .filter(F.col("a") != F.col("b"))
             .join(pair_values(groups, cells, tile_bits, leaf_bits), ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    terms = cells.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
