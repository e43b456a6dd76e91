"""Source divergence audit against plain whole-number versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, awkward, awkward_frame, lower
from trailsift.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
E9 = 10 ** 9


def plain(rows, least_docs=3, top=200):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = TERM.findall(lower(text))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        groups = [g for g in counts if g[0] == lang]

        def shares(found):
            mass = sum(found[t] for t in kept) + len(kept)
            return {t: 1 + E9 * (found[t] + 1) // mass for t in kept}
        p = {g: shares(counts[g]) for g in groups}
        q = shares(sum((counts[g] for g in groups), Counter()))

        def price(x, y):
            return (x - y) * (x - y) // y
        for g in groups:
            pairs = [(sum(price(p[g][t], p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            terms = [(price(p[g][t], q[t]), t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, g[1], part, item, value, i + 1) for i, (value, item) in enumerate(found[:last])]
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in A.audit(df, **how).collect())


@pytest.mark.parametrize("bits", [(6, 6), (1, 1), (2, 0)])
def test_all_tile_sizes_give_the_plain_result(spark, bits):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcXYZéß") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, "".join(rng.choice(words[:rng.choice((5, 60))]) + rng.choice(" 1,\n-") for _ in range(rng.randint(0, 40))),
             rng.choice("ef"), "s" + str(min(rng.randint(0, 9), rng.randint(0, 9))), None) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(df, tile_bits=bits[0], leaf_bits=bits[1]) == plain(rows)
    assert got(df, least_docs=8, top=2, tile_bits=bits[0], leaf_bits=bits[1]) == plain(rows, 8, 2)


def test_awkward_rows(spark):
    assert got(awkward_frame(spark)) == plain(awkward())
    assert got(awkward_frame(spark), least_docs=1000) == plain(awkward(), 1000)  # V = 0: pairs of value 0, no terms


def test_empty_and_null(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    assert got(spark.createDataFrame([(None,) * 5], DOCS)) == []  # one group: no pairs
    rows = [(1, None, None, None, None), (2, None, None, "b", None)]
    assert got(spark.createDataFrame(rows, DOCS)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_pieces_cut_between_terms():
    data = ("Ab é1 " * 500 + "x" * 300 + "9").encode()
    want = [t.encode() for t in TERM.findall(lower(data.decode()))]
    for size in (1, 7, 100, 10 ** 6):
        assert [t for piece in A.pieces(data, size) for t in piece] == want


def test_full_counting_tables_are_written_out(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(A, "HELD_TERMS", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 4, "source": ["s", "s", "t", "s"],
                                        "text": ["x y z w", "x", "x q", "x y"]})
    parts = list(A._count(iter([batch, batch])))
    total = Counter()
    for part in parts:
        for r in part.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert len(parts) > 3 and total["s", "x"] == 6 and total["t", "q"] == 2 and total["s", None] == 0


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F
    pairs = [(0, 1), (0, 7), (6, 7), (2, 3), (10 ** 13, 3 * 10 ** 13 + 1), (4 * 10 ** 15, 9 * 10 ** 15), (0, 10 ** 12)]
    df = spark.createDataFrame(pairs, "c long, m long")
    for r in df.select("c", "m", A.share(F.col("c"), F.col("m")).alias("p")).collect():
        assert r["p"] == 1 + E9 * (r["c"] + 1) // r["m"]


def test_joint_traversal_meets_every_common_leaf():
    rng = np.random.default_rng(0)
    for density in (0, 0.02, 0.3, 1):
        a, b = rng.random((8, 8)) < density, rng.random((8, 8)) < density
        found = {(int(i), int(j), c) for x, y, c in A.joint_leaves(A.quadtree(a), A.quadtree(b)) for i, j in zip(x, y)}
        assert found == {(i, j, c) for i in range(8) for j in range(8) for c in range(8) if a[i, c] and b[j, c]}
