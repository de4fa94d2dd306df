"""Every catalogue query against its SQL on the small driver tables."""

import os
import re

import duckdb
import pytest
from docloom import bucket_catalog, catalog
from docloom.sources.bucket import Bucket

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = {**catalog.QUERIES, **bucket_catalog.QUERIES}
ORACLES = {**catalog.ORACLES, **bucket_catalog.ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def shown(value):
    return repr(round(value, 6) if isinstance(value, float) else value)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES) + ["bucket_update_sector", "bucket_changes", "dynamic_sort", "bucket_transform", "bucket_counts", "bucket_indexes", "bucket_poll", "bucket_live_tail", "json_codec", "record_codec"])
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    expected = sql.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in expected.fetchall())


def test_python_processes(spark, sql, monkeypatch):
    """A task that writes or finds rows runs one Python step, and no list of rows goes through Python workers of its own."""
    plans, written = [], Bucket._written

    def seen(self, df, state):
        plans.append(df.select(*state.struct.names)._jdf.queryExecution().executedPlan().toString())
        return written(self, df, state)

    monkeypatch.setattr(Bucket, "_written", seen)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    found = QUERIES["dynamic_update"](spark, SF)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(sql.sql(ORACLES["dynamic_update"]).fetchall())
    assert max(len(re.findall(r"\b(?:ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow)\b", p)) for p in plans) == 1
