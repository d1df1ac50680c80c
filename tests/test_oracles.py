"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
gate runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from farebox import catalog
from scripts.check_oracle import digest, type_mismatches

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 100
    assert all(callable(f) for f in QUERIES.values())
    # Every query of the ride part has a SQL twin.
    assert set(catalog.QUERIES) <= set(ORACLES)
    assert set(catalog.QUERIES) <= set(QUERIES)
    for key in ("insert_if_absent", "first_wins_dedup", "eda_csv_scan", "eda_view"):
        assert key in QUERIES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["vehicle_type", "payment_method", "total_rides", "avg_value", "total_distance"]
    df.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    srows = [tuple(r) for r in df.collect()]
    res = duck.sql(ORACLES[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert type_mismatches(df, res) == {}
    assert len(srows) == len(drows)
    hs, ls = digest(df.columns, srows)
    hd, ld = digest(res.columns, drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])
