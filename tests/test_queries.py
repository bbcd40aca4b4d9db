"""Every query with an oracle equals it on the smallest tables."""

import duckdb
import pytest

from pipeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(r) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_oracle(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [x.replace(".0,", ",").replace(".0]", "]") for x in rows(got)] == [x.replace(".0,", ",").replace(".0]", "]") for x in rows(want)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
