"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from treekin.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    near = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(map(near, got.select(*names).collect()), key=key) == sorted(map(near, want.fetchall()), key=key)


def test_scores_of_all_users_can_be_recovered(spark):
    """Each user has one representative, and the pairs of call_graph_similarity are all pairs of these."""
    rows = QUERIES["call_graph_members"](spark, SMALL).collect()
    stands = sorted({r["representative"] for r in rows})
    users = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().collect()
    assert sorted(r["user_id"] for r in rows) == sorted(r["user_id"] for r in users)
    pairs = QUERIES["call_graph_similarity"](spark, SMALL).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(a, b) for a in stands for b in stands if a < b]


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["component", "size", "ids"]
