"""Every registered ledger query against its SQL on the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import resample
from tallyloom.plans import catalogue

from .compare import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return connection(SF)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_settled_trades_are_narrow(spark, monkeypatch):
    """Queries that need a trade's outcome only write nothing else to the shared folder."""
    from tallyloom.plans import catalogue

    settled, plain = [], catalogue.settle
    monkeypatch.setattr(catalogue, "settle", lambda df: settled.append(df.columns) or plain(df))
    catalogue.metrics_behavioural(spark, "/root/testdata/sf0.001")
    catalogue.mc_bootstrap(spark, "/root/testdata/sf0.001")
    assert settled == [["strategy_id", "seq", "timestamp", "capped_pnl"]] * 2


def test_estimate_counts_paths_as_whole_cents_do(spark, tmp_path):
    """Of this user's paths of test A one sums to 0.00, of which doubles leave 7e-15; the SQL of the estimate has no gain there, either."""
    events = "/root/testdata/sf0.1/events.parquet"
    if not os.path.exists(events):
        pytest.skip("no test tables here")
    own = spark.read.parquet(events).filter("user_id = 907").withColumns({"user_id": F.col("user_id") + 6000, "event_id": F.col("event_id") + 400_000})
    own.write.parquet(f"{tmp_path}/events.parquet")
    cents = np.rint(np.array([r.capped_pnl for r in catalogue.trades(spark, str(tmp_path)).orderBy("seq").collect()]) * 100).astype(int)
    gains = {t: int((cents[resample.positions(t, len(cents), "6907", np.arange(1000), catalogue.CONFIG)].sum(axis=1) > 0).sum()) for t in ("a", "mb")}
    assert gains == {"a": 986, "mb": 968}
    assert "RR gap=+0.018;" in catalogue.QUERIES["overfit_estimate"](spark, str(tmp_path)).first().summary
