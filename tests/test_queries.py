"""Every registered raster query against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans import files
from gridloom.plans import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", list(files.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    if name not in Q.ORACLES:
        assert got
        return
    want = duck.sql(Q.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = want.project(",".join(f'"{c}"' for c in columns)).fetchall()
    assert got == sorted(repr(tuple(_plain(x) for x in r)) for r in rows)


def test_float24_at_every_exponent(spark, tmp_path):
    """Powers of two, their neighbours and the subnormals' ends, of either sign, and a null."""
    bits = [s << 23 | e << 16 | m for s in (0, 1) for e in range(128) for m in (0, 1, 2, 4, 32768, 65535)]
    keys = [b * pow(7919, -1, 1 << 24) % (1 << 24) for b in bits]
    spark.createDataFrame([(k,) for k in [*keys, None, -1, -65536]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = Q.QUERIES["float24_decode"](spark, f"{tmp_path}").collect()
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert {r.bits for r in got} > set(bits)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(Q.ORACLES["float24_decode"]).fetchall()))
