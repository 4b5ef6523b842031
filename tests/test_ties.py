"""Queries on books that share their coin and time, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as e
from tidebook.operators import asof


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of three coins, every seventh at the time of the coin's event before it."""
    folder = tmp_path_factory.mktemp("tied")
    duckdb.connect().execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST((i - CASE WHEN i % 7 = 0 AND i > 2 THEN 3 ELSE 0 END) * 29 AS INTEGER)) AS ts,
                         i % 3 AS user_id, (i * i * 37 % 1009) / 10.0::DOUBLE AS value FROM range(900) t(i) ORDER BY i) TO '{folder}/events.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "dedup_books",
        "forward_index",
        "forward_returns",
        "hac_regression",
        "hit_rate",
        "information_coefficient",
        "net_of_cost",
        "trade_book_match",
        "ols_univariate",
        "train_threshold",
    ],
)
def test_ties_go_in_the_order_of_events(spark, tied, name):
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
    want = sorted(map(repr, db.execute(e.oracle_sql()[name]).fetchall()))
    assert sorted(repr(tuple(r)) for r in e.queries()[name](spark, tied).collect()) == want


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_the_last_of_books_received_together_is_matched(spark, order):
    books = spark.createDataFrame([("X", 5, 5, i) for i in order], "coin string, exch_time_ms long, recv_ts_ns long, event_id long")
    trades = spark.createDataFrame([("X", 6)], "coin string, exch_time_ms long")
    assert [r.event_id for r in asof.book_before_trade(trades, books, ["event_id"], ties=("event_id",)).collect()] == [2]
