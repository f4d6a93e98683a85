"""Every query over the tape where prices and amounts never change: none fails, and the twins agree on what is null."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
NAMES = sorted(n for n in QUERIES if "lineitem" in ORACLES.get(n, "lineitem"))


@pytest.fixture(scope="module")
def still(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("still")
    for f in os.listdir(DATA):
        if f != "lineitem.parquet":
            os.symlink(f"{DATA}/{f}", folder / f)
    tape = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumns({"l_quantity": F.lit(10.0), "l_extendedprice": F.lit(1000.0)})
    tape.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(folder / f) else f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return str(folder), con


def plain(v):
    """Numbers as floats, what is not finite as null (DuckDB divides by zero without an error), others as text."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return None
    try:
        return round(float(v), 6) + 0.0 if not isinstance(v, (str, bool)) else str(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_still_prices(spark, still, name):
    folder, con = still
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLES:
        r = con.execute(ORACLES[name])
        place = [[d[0] for d in r.description].index(c) for c in columns]
        want = sorted((tuple(plain(row[i]) for i in place) for row in r.fetchall()), key=repr)
        # Halves may be rounded either way.
        close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
        assert len(got) == len(want) and all(all(map(close, a, b)) for a, b in zip(got, want, strict=True))
