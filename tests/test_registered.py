"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
import compare

QUERIES = {name: query for name, query in registered.queries().items() if name in registered._QUERIES}
ORACLE = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(small):
    with compare.duck(small) as c:
        yield c


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, small, connection, name):
    assert compare.assert_same(QUERIES[name](spark, small), connection, ORACLE[name]) > 0


def test_entry_has_rows(spark):
    assert registered.entry(spark).count() == 1


# Figures of the derived book on the smallest tables, worked out beforehand.
def test_known_figures(spark, small):
    kpis = QUERIES["portfolio_kpis"](spark, small).first()
    assert (kpis.total_contracts, kpis.delinquent_contracts) == (1265, 464)
    assert (kpis.dpd_30_plus_contracts, kpis.dpd_90_plus_contracts) == (363, 205)
    assert str(kpis.total_outstanding) == "2057190975.50"
    assert str(kpis.total_overdue) == "403164572.70"
    buckets = [r.contract_count for r in QUERIES["dpd_bucket_summary"](spark, small).collect()]
    assert buckets == [801, 104, 86, 69, 205]
    listed = QUERIES["high_risk_watchlist"](spark, small).groupBy("priority").count().collect()
    assert dict(map(tuple, listed)) == {"Critical": 217, "High": 85, "Medium": 85}


def test_changed_files_are_noticed(spark, small, tmp_path):
    for name in ("orders", "lineitem", "customer"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = QUERIES["contract_status_counts"](spark, str(tmp_path)).groupBy().sum("contracts").first()[0]
    orders = spark.read.parquet(f"{small}/orders.parquet").limit(100)
    orders.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["contract_status_counts"](spark, str(tmp_path)).groupBy().sum("contracts").first()[0] == 100 < first
