"""Returns are differences of the logarithms that the SQL's engine takes, to the last bit."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.functions.book import ln
from tidebook.operators import asof, features

#: Mids of a rising book: of Spark's own logarithms of these, some differ in the last bit.
MIDS = [9_000 + i / 4 for i in range(2_000)]


@pytest.fixture(scope="module")
def books(spark):
    rows = [("X", i, m - 0.25, m + 0.25, m, [1.0], [1.0]) for i, m in enumerate(MIDS)]
    return spark.createDataFrame(rows, "coin string, exch_time_ms long, best_bid double, best_ask double, mid double, bid_sz array<double>, ask_sz array<double>")


@pytest.fixture(scope="module")
def logs():
    return [r[0] for r in duckdb.connect().execute("SELECT ln(9000 + i / 4.0::DOUBLE) FROM range(2000) t(i) ORDER BY i").fetchall()]


def test_log_returns(books, logs):
    got = {r.exch_time_ms: r.log_ret_1 for r in features.with_flow(books).collect()}
    assert [got[i] for i in range(len(MIDS))] == [None, *[b - a for a, b in zip(logs, logs[1:])]]


def test_forward_returns(books, logs):
    got = {r.exch_time_ms: r.fwd_logret_mid_7ms for r in asof.forward_returns(books, [7], ("mid",)).collect()}
    assert [got[i] for i in range(len(MIDS))] == [*[b - a for a, b in zip(logs, logs[7:])], *[None] * 7]


def test_no_logarithm_of_what_is_not_above_0(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, -1.0), (3, None)], "i int, x double")
    assert [r.y for r in df.select("i", ln(F.col("x")).alias("y")).orderBy("i").collect()] == [0.0, None, None, None]
