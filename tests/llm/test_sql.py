"""Queries against their DuckDB SQL, and the registration."""

import os

import pytest

from tests import oracle_harness
from trailsift.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small)
    columns = sorted(got.columns)
    want = oracle_harness.duck(sf_small).sql(SQL[name])
    assert sorted(want.columns) == columns

    def rows(found):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=str)
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names and set(SQL) <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "trailsift")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "trailsift.llm" not in open(os.path.join(folder, f)).read(), f
