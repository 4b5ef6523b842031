"""Ranks and exact quantiles of the values of a group, however many there are.

For ranks, values are counted first; the counts are cut at the group's approximate quantiles into buckets, and ranks are
running sums within a bucket on top of those of the buckets below. So no group is sorted in one task. A quantile needs
less: approximate ones bracket it, and only the bracket is sorted. Cuts and brackets, a row per group, are broadcast:
joined otherwise, a group would be one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_ranks(df: DataFrame, value: str, by: list[str], buckets: int = 64) -> DataFrame:
    """(by..., value, _n, _before): how often each value comes in its group, and how many are smaller.
    -0.0 and 0.0 are one value."""
    plain = F.when(F.col(value) == 0, F.lit(0).cast(df.schema[value].dataType)).otherwise(F.col(value))
    counts = df.select(*by, plain.alias(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if buckets & (buckets - 1):
        raise ValueError("buckets are halved, so their number is a power of 2")
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, shares, 1000).alias("_cuts"))
    # how many cuts are smaller, by halving
    counts, step = counts.join(F.broadcast(cuts), by).withColumn("_bucket", F.lit(0)), buckets // 2
    while step:
        more = F.when(F.get("_cuts", F.col("_bucket") + (step - 1)) < F.col(value), F.lit(step)).otherwise(F.lit(0))
        counts, step = counts.withColumn("_bucket", F.col("_bucket") + more), step // 2
    counts = counts.drop("_cuts")
    sums = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_sum"))
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_below"))
    within = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(sums, [*by, "_bucket"])
    return counts.select(*by, value, "_n", (F.col("_below") + F.col("_in")).alias("_before"))


def quantile(df: DataFrame, value: str, share: float, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """(by..., quantile): the exact quantile of the group's values, interpolated between the two ranks it falls between.
    Nulls are left out; a group of nulls has no row.

    Approximate quantiles a little below and above the share bracket it. Values below the bracket are only counted, those beyond it
    not looked at, so what is shuffled and sorted is the bracket: about 8 / accuracy of a group's values, and ties once. Groups of fewer
    than `accuracy` values are their own bracket.
    """
    value_ = F.when(F.col(value) == 0, F.lit(0).cast(df.schema[value].dataType)).otherwise(F.col(value))
    df = df.where(F.col(value).isNotNull()).select(*by, value_.alias("_v"))
    low, high = share - 4 / accuracy, share + 4 / accuracy  # four times the error that the approximate ones may have
    found = F.percentile_approx("_v", [max(low, 0.0), min(high, 1.0)], accuracy)
    bounds = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"), found.alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_count") < accuracy
    ends = {"_from": F.when(small, F.col("_least")).otherwise(F.col("_c")[0]), "_to": F.when(small, F.col("_most")).otherwise(F.col("_c")[1])}
    bounds = bounds.select(*by, (F.lit(float(share)) * (F.col("_count") - 1)).alias("_at"), *[c.alias(n) for n, c in ends.items()])
    inside = df.join(F.broadcast(bounds), by)
    inside = inside.where(F.col("_v") <= F.col("_to")) if high < 1 else inside
    kept = F.when(F.col("_v") >= F.col("_from"), F.col("_v")) if low > 0 else F.col("_v")
    counts = inside.groupBy(*by, kept.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.first("_at").alias("_at"))
    below = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    first, second = (F.max(F.when(holds(f("_at")), F.col("_v"))).cast("double") for f in (F.floor, F.ceil))
    ends = counts.groupBy(*by).agg(first.alias("_low"), second.alias("_high"), F.first("_at").alias("_at"))
    return ends.select(*by, (F.col("_low") + (F.col("_at") - F.floor("_at")) * (F.col("_high") - F.col("_low"))).alias("quantile"))
