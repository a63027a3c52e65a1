"""Every core query with an oracle gives DuckDB's rows on the smallest data."""

import glob
import math

import duckdb
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
