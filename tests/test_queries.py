"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from sievewright.plans import entity_queries  # noqa: F401
from sievewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.5f}" if isinstance(x, (float, int)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    frame = QUERIES[name](spark, SF)
    expected = oracle.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(expected.columns, expected.fetchall())


def test_relevance_of_documents_without_source(spark, oracle, tmp_path):
    """Documents without a source ask only where every hundredth does, and are found by those."""
    oracle.sql(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN source END AS source) FROM documents) TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    frame, expected = QUERIES["relevance"](spark, str(tmp_path)), con.sql(ORACLE_SQL["relevance"])
    assert rows_of(frame.columns, frame.collect()) == rows_of(expected.columns, expected.fetchall())
