"""The registered queries: against their SQL where there is any, else one row for each document."""

import os

import pytest

import __spark_entry__ as entry
from tallyloom.llm import queries

from ..compare import connection, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(connection(SF).sql(queries.ORACLE_SQL[name]).df())
    if "doc_id" in got:
        each = got[got["piece"] == 0] if "piece" in got else got
        assert sorted(each["doc_id"]) == sorted(spark.read.parquet(f"{SF}/documents.parquet").toPandas()["doc_id"])
