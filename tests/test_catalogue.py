"""Every registered catalogue query against its oracle on the smallest data, and its plan where that matters."""

import math

import duckdb
import pytest

from lumenvault.plans.fixtures import TABLES
from lumenvault.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6)) if math.isfinite(v) else str(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    assert want, "a query without rows tests nothing"


def test_prefix_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("gallery/a", 1), ("x", 2)], "key string, size long").write.parquet(str(tmp_path / "o"))
    plan = spark.read.parquet(str(tmp_path / "o")).where("startswith(key, 'gallery/')").select("key")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(key,gallery/)" in plan and "ReadSchema: struct<key:string>" in plan
