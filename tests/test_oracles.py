"""Every registered query against its SQL on the same tables."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"create view {name} as select * from '{source}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    assert theirs
