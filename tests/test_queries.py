"""Every core query against its SQL on the smallest tables, and the shape of some plans."""

import duckdb
import pytest

from strandline import dataset_queries
from strandline.queries import ORACLE_SQL, QUERIES

assert dataset_queries  # registers its queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    if isinstance(value, list | tuple):
        return str([_plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted("|".join(_plain(r[c]) for c in columns) for r in got.collect())
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted("|".join(_plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())


def test_plans(spark):
    text = lambda name: QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text("merge_reindex")
    assert "CartesianProduct" not in text("range_join") and "NestedLoop" not in text("range_join")
    scan = text("drop_feature")
    assert "props" not in scan[scan.index("ReadSchema") :]
    assert "Join" not in text("tail_align")
