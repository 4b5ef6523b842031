"""Tables with a row per coin or cell are broadcast however large Spark takes them to be: no coin is one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebook.operators import ranks, stats


@pytest.fixture
def unsized(spark):
    """No table is broadcast for its size, as when the sizes of aggregates are not known."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def books(spark):
    return spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 3).alias("coin"), F.col("id").alias("exch_time_ms"), (F.col("id") * 7 % 31).cast("double").alias("x"))


@pytest.mark.parametrize(
    "of",
    [
        stats.chronological_split,
        stats.with_history,
        lambda df: ranks.quantile(df, "x", 0.5, ["coin"]),
    ],
    ids=["split", "history", "quantile"],
)
def test_books_are_not_shuffled_by_coin_alone(unsized, of):
    out = of(books(unsized))
    assert out.count() in (3, 300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
