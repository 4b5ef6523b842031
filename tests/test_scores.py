"""Newey-West errors from stretches of a coin's rows: what is shuffled, and sums that reach over stretches and batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import stats

FEATURES, HORIZONS = ["f", "g"], [10, 20]


@pytest.fixture
def crumbs(spark):
    """Many small partitions and batches."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def table(spark, n):
    rng = np.random.default_rng(3)
    value = lambda: None if rng.random() < 0.1 else float(rng.normal())
    rows = [(coin, i // 2 * 2, i, *[value() for _ in range(5)]) for coin in "AB" for i in range(n)]
    return spark.createDataFrame(rows, "coin string, exch_time_ms long, event_id long, f double, g double, fwd_logret_mid_10ms double, fwd_logret_mid_20ms double, c double")


@pytest.mark.parametrize("lags", [1, 5, 90])
def test_sums_over_stretches_match_the_matrix_form(crumbs, lags):
    df = table(crumbs, 60)
    rows = df.collect()
    lag = crumbs.createDataFrame([(c, h, lags) for c in "AB" for h in HORIZONS], "coin string, horizon_ms long, lags int")
    cells = stats.long_form(df, FEATURES, HORIZONS, keep=("c", "event_id"))
    for wide in (None, df):
        got = stats.hac_regression(cells, ["c"], lag, ("event_id",), wide).collect()
        assert len(got) == 8
        for r in got:
            of = [(x[r.feature], x["c"], x[f"fwd_logret_mid_{r.horizon_ms}ms"]) for x in rows if x.coin == r.coin]
            x, c, y = np.array([v for v in of if None not in v]).T
            a = np.column_stack([np.ones(len(x)), x, c])
            beta = np.linalg.lstsq(a, y, rcond=None)[0]
            s = a * (y - a @ beta)[:, None]
            cov = s.T @ s
            for j in range(1, min(lags, len(x) - 1) + 1):
                g = s[j:].T @ s[:-j]
                cov += (1 - j / (lags + 1)) * (g + g.T)
            inv = np.linalg.inv(a.T @ a)
            assert r["beta"] == pytest.approx(beta) and r["t"] == pytest.approx(beta / np.sqrt(np.diag(inv @ cov @ inv))) and (r.n, r.lags) == (len(x), lags)


@pytest.mark.parametrize(("name", "told"), [("hac_regression_controls", "t"), ("imbalance_study", "spearman")])
def test_no_table_of_the_query_has_a_row_per_cell_and_book(spark, tmp_path, monkeypatch, name, told):
    """The cells of a book are not stored or shuffled one by one."""
    import duckdb

    import __spark_entry__ as e
    from tidebook.operators import study
    from tidebook.plans import queries

    duckdb.connect().execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(i * 29 AS INTEGER)) AS ts, i % 3 AS user_id, (i * i * 37 % 1009) / 100.0::DOUBLE AS value
                  FROM range(3000) t(i)) TO '{tmp_path}/events.parquet'"""
    )
    sizes = []

    def counted(real):
        def of(df, name, *args, **more):
            out = real(df, name, *args, **more)
            sizes.append((name, out.count()))
            return out

        return of

    for module in (stats, study, queries):
        monkeypatch.setattr(module, "stored", counted(module.stored))
    rows = e.queries()[name](spark, str(tmp_path))
    assert rows.where(F.col(told).isNotNull()).count() == 75
    assert sizes and max(n for _, n in sizes) <= 3000
