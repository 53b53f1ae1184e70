"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import more, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES | more.QUERIES, registry.SQL | more.SQL
TABLES = ("documents", "embeddings", "conversations", "benchmark", "pages", "labels", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["rowid", "score_micro"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_branch_is_reached(db):
    """The checks above compare more than empty or constant results."""
    one = lambda name, what: db.execute(f"SELECT {what} FROM ({SQL[name]})").fetchone()
    noise, correction, low, kinds = one("predicates", "count(*) FILTER (noise), count(*) FILTER (correction), count(*) FILTER (NOT above_floor), list(DISTINCT category)")
    assert min(noise, correction, low) > 0 and set(kinds) >= {"correction", "preference", "decision", "method", "reference"}
    assert min(one("condensed_logs", "count(*) FILTER (flagged > 0), count(*) FILTER (elided > 0), count(*) FILTER (grew), count(*) FILTER (NOT grew)")) > 0
    assert one("scalars", "count(*) FILTER (links > 0)")[0] > 0
    assert one("similar_asks", "count(*)")[0] > 0
    for name in ("recurring_asks", "recurring_documents"):
        groups, rows = one(name, "count(DISTINCT founder), count(*)")
        assert 0 < groups < rows
    assert one("gated_retrieval", "count(*)")[0] > 0 and one("recall_report", "hit_at_k")[0] > 0 and one("search_lines", "count(*)")[0] > 0
