"""Rows of one place: the SQL leaves their order open; with its order completed by the other columns both engines must agree on every row."""

import duckdb
import pytest
from test_queries import rows

from civicforms.plans.registry import ORACLE, QUERIES

#: Each ORDER BY of a query's SQL that leaves rows open, and the columns that Spark goes by then.
COMPLETED = {
    "dedupe_near": {"pos": "type, x, y, w, h, confidence, context"},
    "dedupe_overlap": {"confidence DESC, pos": "x, y, w, h"},
    "detect_fields": {"x, y, pos": "abs(w), abs(h), h", "pos": "x, y, w", "source, band, pos": "type, x, y, w, h, confidence, context"},
}


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey % 200 + l_partkey % 7 * 1000 AS l_partkey) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), con


def completed(name, direction):
    sql = ORACLE[name]
    for order, rest in COMPLETED[name].items():
        assert f"ORDER BY {order})" in sql
        sql = sql.replace(f"ORDER BY {order})", f"ORDER BY {order}, " + ", ".join(f"{c} {direction}" for c in rest.split(", ")) + ")")
    return sql


@pytest.mark.parametrize("name", sorted(COMPLETED))
def test_tied_rows_go_by_their_other_columns(spark, tied, name):
    folder, con = tied
    found = rows(QUERIES[name](spark, folder).toPandas())
    assert found == rows(con.execute(completed(name, "ASC")).df())
    assert found != rows(con.execute(completed(name, "DESC")).df())
