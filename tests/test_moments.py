"""Frames by differences of running sums against numpy, and their cost against the length of the frame."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import moments

SERIES = "coin string, exch_time_ms long, v double"


def series(spark, n=400, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for c, shift in (("A", 0.0), ("B", 1e6)):
        v = np.round(rng.normal(size=n) * 3, 3) + shift
        v[100:180] = shift + 2.5  # equal values for a while
        v[250:] += 40.0  # and a jump
        t = np.cumsum(rng.integers(1, 50, n))
        rows += [(c, int(a), None if i % 37 == 5 else float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
    return rows, spark.createDataFrame(rows, SERIES).repartition(5)


@pytest.mark.parametrize("rows", [1, 7, 60, 1000])
@pytest.mark.parametrize("block_ms", [200, 10**9])
def test_frames_of_rows(spark, rows, block_ms):
    data, df = series(spark)
    got = {(r.coin, r.exch_time_ms): r for r in moments.over_rows(df, "v", rows, block_ms=block_ms).withColumn("sd", moments.rolling_deviation(2)).collect()}
    assert len(got) == len(data)
    for c in "AB":
        mine = [x for x in data if x[0] == c]
        for i, x in enumerate(mine):
            frame = np.array([y[2] for y in mine[max(0, i - rows + 1) : i + 1] if y[2] is not None])
            g = got[c, x[1]]
            assert g._n == len(frame)
            if len(frame) > 1:
                assert g.sd == pytest.approx(frame.std(ddof=1), rel=1e-6, abs=1e-7) and (frame.std() > 0 or g.sd == 0.0)
            else:
                assert g.sd is None
            if len(frame) and x[2] is not None:
                assert g._x - g._mean == pytest.approx(x[2] - frame.mean(), abs=1e-6)


@pytest.mark.parametrize("lookback", [10, 300, 10**6])
def test_steps_within_a_time(spark, lookback):
    data, _ = series(spark, 200, 4)
    data = [(c, t, 5.0 if v is None else v) for c, t, v in data]
    got = {(r.coin, r.exch_time_ms): r.sigma for r in moments.step_deviation(spark.createDataFrame(data, SERIES), "v", lookback, block_ms=400).collect()}
    for c in "AB":
        mine = [x for x in data if x[0] == c]
        for i, x in enumerate(mine):
            frame = [y[2] for y in mine[: i + 1] if y[1] >= x[1] - lookback]
            assert got[c, x[1]] == pytest.approx(float(np.std(np.diff(frame))) if len(frame) > 2 else 0.0, rel=1e-6, abs=1e-7)


def test_cost_does_not_grow_with_the_frame(spark):
    df = spark.range(120_000).select(F.lit("A").alias("coin"), (F.col("id") * 1000).alias("exch_time_ms"), F.rand(3).alias("v"))

    def seconds(rows):
        began = time.perf_counter()
        moments.over_rows(df, "v", rows).agg(F.sum("_m2")).collect()
        return time.perf_counter() - began

    seconds(300)
    assert seconds(30_000) < 2 * max(seconds(300), 1.0)


def test_no_rows(spark):
    assert moments.over_rows(spark.createDataFrame([], SERIES), "v", 5).collect() == [] == moments.step_deviation(spark.createDataFrame([], SERIES), "v", 5).collect()
