"""Registered queries against their DuckDB oracles on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewater import catalog_queries  # noqa: F401
from tidewater import queries as Q

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")

#: One query of each kind; all of the others are compared in the same way at a larger size elsewhere.
SOME = [
    "filter_not", "filter_ne", "filter_glob", "filter_accessed_before", "filter_json_path", "knn_filtered", "knn_decay_gaussian", "knn_space", "knn_batch",
    "knn_access_tracking", "bm25_repeated_term", "hybrid_weighted", "multi_space", "clusters", "episodes", "episodes_per_user", "thread", "evict_lru",
    "traverse_typed", "traverse_outgoing", "upsert_by_key", "wal_replay", "insert_batch_ids", "expand_search",
]
SOME += [n for n, q in Q.queries().items() if q.__module__ == "tidewater.catalog_queries" and n in Q.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(found):
    return sorted(map(tuple, found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_duckdb(spark, duck, name):
    df = Q.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    want = duck.sql(Q.oracle_sql()[name]).project(",".join(f'"{c}"' for c in columns)).fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)
