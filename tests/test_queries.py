"""Every registered query of the library against its SQL, and the others against what they promise."""

import math

import pytest

from folioflow.plans import block_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({queries.SQL[name]})").fetchall()
    a = sorted(tuple(map(plain, r)) for r in want)
    b = sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
