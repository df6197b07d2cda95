"""Every registered query of the engine against DuckDB on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from vellum import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    want = db.sql(Q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_drain_follows_the_batch_policy(spark):
    rows = Q.drain_stream(spark, SF).collect()
    events = {r.event_id: r for r in Q.table(spark, SF, "events").collect()}
    assert len(rows) == len(events)
    place = {}
    for r in sorted(rows, key=lambda r: (r.name, r.seq)):
        place[r.name] = place.get(r.name, 0) + 1
        fails = events[r.seq].user_id % 7
        assert (r.name, r["index"]) == (events[r.seq].event_type, place[r.name])
        assert (r.attempts, r.status) == ((fails + 1, "done") if fails < 5 else (5, "dead"))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
