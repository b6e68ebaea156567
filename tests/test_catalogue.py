"""Every registered query against its SQL."""

import math

import pytest

from tagloom.catalogue import ORACLES, QUERIES


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows(rel.columns, rel.fetchall())
    else:
        assert df.columns
