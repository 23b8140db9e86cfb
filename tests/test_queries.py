"""Every query with SQL against DuckDB over the same small tables, as the driver compares them."""

from __future__ import annotations

import math

import duckdb
import pytest

from docspark.plans import MODULES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    found = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    rows = [[plain(v) for v in r] for r in got.select(*columns).collect()]
    want = [[plain(v) for v in r] for r in found.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["align_statements", "lookup_tool", "claim_status"])
def test_every_segment_has_a_row(spark, name):
    from docspark.sources.tables import read

    assert QUERIES[name](spark, D).count() == read(spark, D, "segments").count()


def test_every_vault_is_asked():
    for name in ("entity_search", "entity_search_token", "lookup_tool"):
        assert "event_id // 4 % 4 AS vault_id" in ORACLES[name]


def test_dedup_claims_takes_every_segment(spark, monkeypatch):
    from docspark.operators import claims
    from docspark.sources.tables import read

    monkeypatch.setattr(claims, "dedup_claims", lambda df: df)
    assert QUERIES["dedup_claims"](spark, D).count() == read(spark, D, "segments").count()
