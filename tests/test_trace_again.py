"""Calls of a trace by tool, also of a tool that no report calls."""

from datetime import datetime, timedelta

import duckdb
import pytest

from brightloom.plans import cases


def _rows(kind):
    """Orders with an urgent one on every day, as large tables have: bundles then start every seven days from the first."""
    urgent = "1-URGENT" if kind == "dense" else "2-HIGH"
    for n in range(150):
        day = datetime(1996, 12, 1) + timedelta(days=n)
        yield 2 * n, "F", day, 450_000.0, urgent
        yield 2 * n + 1, "F", day, 120_000.0 + 7 * n, "5-LOW"


@pytest.mark.parametrize("kind", ["dense", "none"])
def test_every_tool_is_listed(spark, tmp_path, kind):
    rows = spark.createDataFrame(list(_rows(kind)), "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_totalprice double, o_orderpriority string")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    own = duckdb.connect()
    own.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    expected = sorted(own.execute(cases.SQL["trace_again"]).fetchall())
    assert ("estimate", 0, 0) in expected
    assert sorted(map(tuple, cases.trace_again(spark, str(tmp_path)).collect())) == expected
