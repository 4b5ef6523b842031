"""Statistics of signals against forward returns, all coins at once.

Input is long: one row per (coin, feature, horizon, time) with x (the signal) and y (the return). Moments
are aggregated, and p-values, normal equations and covariances are columns over them: what comes out is a DataFrame with a row
per (coin, feature, horizon), and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import binomial_two_sided, correlation_p, normal_two_sided, t_two_sided
from ..store import once, stored
from . import ranks
from .ranks import value_ranks
from .scores import Cell, window_products

CELL = ["coin", "feature", "horizon_ms"]


def chronological_split(df: DataFrame, train_fraction: float = 0.7, time: str = "exch_time_ms") -> DataFrame:
    """df with is_train: up to the cutoff between a coin's first and last time. The two bounds come from
    an aggregate, not a window, and are broadcast: so no coin goes through one task."""
    ends = df.groupBy("coin").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    cut = F.col("_lo") + train_fraction * (F.col("_hi") - F.col("_lo"))
    return df.join(F.broadcast(ends), "coin").withColumn("is_train", F.col(time) <= cut).drop("_lo", "_hi")


def with_history(df: DataFrame, least: int = 50) -> DataFrame:
    """Only coins with that many rows."""
    enough = df.groupBy("coin").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least).select("coin")
    return df.join(F.broadcast(enough), "coin", "left_semi")


def long_form(df: DataFrame, features: list[str], horizons_ms: list[int], label: str = "mid", keep: tuple[str, ...] = ("spread_bps",)) -> DataFrame:
    """(coin, feature, horizon_ms, exch_time_ms, x, y, keep...) of the wide table."""
    fs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    hs = F.array(*[F.struct(F.lit(int(h)).cast("long").alias("horizon_ms"), F.col(f"fwd_logret_{label}_{h}ms").alias("y")) for h in horizons_ms])
    df = df.select("coin", "exch_time_ms", *keep, F.explode(fs).alias("f"), hs.alias("hs"))
    return df.select("coin", "exch_time_ms", *keep, "f.*", F.explode("hs").alias("h")).select("coin", "feature", "h.horizon_ms", "exch_time_ms", *keep, "x", "h.y")


def _corr(x: str, y: str) -> Column:
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.count(F.lit(1)) >= 10), F.corr(x, y))


def information_coefficient(cells: DataFrame, row: tuple[str, ...] = ("exch_time_ms",)) -> DataFrame:
    """n, pearson and spearman per cell with their p-values, over pairs without nulls; null below 10 pairs or without
    spread. Ranks of values come from their counts, in blocks.

    A feature has the same ranks at two horizons if the same times have pairs there, and so have the returns of a horizon with two
    features. Cells are told by their number of pairs and a hash over their rows, which the columns `row` tell apart, and each
    such set is ranked once. Cells that are made from a stored table are made again for each pass, as they are many times its rows.
    """
    pairs = once(cells.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*CELL, *row, plain("x").alias("x"), plain("y").alias("y")), "pairs")
    sets = stored(pairs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(*row)).alias("_times")), "sets")
    first = lambda c, *by: F.min(c).over(Window.partitionBy(*by, "_n", "_times"))
    # sets has a row per cell
    sets = sets.withColumns({"_horizon": first("horizon_ms", "coin", "feature"), "_feature": first("feature", "coin", "horizon_ms")}).drop("_n", "_times")
    told = pairs.drop(*row).join(F.broadcast(sets), CELL)
    by_x, by_y = ["coin", "feature", "_horizon"], ["coin", "horizon_ms", "_feature"]
    ranked = told
    for value, by, own in (("x", by_x, F.col("horizon_ms") == F.col("_horizon")), ("y", by_y, F.col("feature") == F.col("_feature"))):
        ranks_ = value_ranks(told.where(own), value, by).select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"{value}_rank"))
        ranked = ranked.join(ranks_, [*by, value])
    out = ranked.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("pearson"), _corr("x_rank", "y_rank").alias("spearman"))
    return out.withColumns({f"{c}_p": correlation_p(F.col(c), F.col("n")) for c in ("pearson", "spearman")})


def plain(value: str) -> Column:
    """The value with -0.0 as 0.0."""
    return F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value))


def directional_accuracy(cells: DataFrame) -> DataFrame:
    """hit_n, hits and hit_rate per cell, over pairs in which neither is null or 0, and the exact p-value of an even chance."""
    moved = cells.where((F.col("x") != 0) & (F.col("y") != 0))
    hits = F.sum((F.signum("x") == F.signum("y")).cast("long"))
    out = moved.groupBy(*CELL).agg(F.count(F.lit(1)).alias("hit_n"), hits.alias("hits"))
    return out.withColumns({"hit_rate": F.col("hits") / F.col("hit_n"), "hit_rate_p": binomial_two_sided(F.col("hits"), F.col("hit_n"))})


def thresholds(train: DataFrame, quantile: float = 0.75) -> DataFrame:
    """The quantile of |x| per (coin, feature), exact and interpolated, nulls left out."""
    size = train.select("coin", "feature", F.abs("x").alias("size"))
    return ranks.quantile(size, "size", quantile, ["coin", "feature"]).withColumnRenamed("quantile", "threshold")


def net_of_cost(cells: DataFrame, limits: DataFrame, taker_bps: float) -> DataFrame:
    """Entering with the sign of x where |x| exceeds the threshold: net_n, mean net_bps after spread and
    two taker fees, its share above 0, t statistic and p-value (null below two rows or without spread)."""
    taken = cells.join(F.broadcast(limits), ["coin", "feature"]).where((F.abs("x") > F.col("threshold")) & F.col("y").isNotNull() & F.col("spread_bps").isNotNull())
    net = F.col("y") * 10_000 * F.signum("x") - (F.col("spread_bps") + 2 * taker_bps)
    out = taken.withColumn("_net", net).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("net_n"),
        F.avg("_net").alias("net_mean_bps"),
        F.avg((F.col("_net") > 0).cast("double")).alias("net_pct_positive"),
        F.stddev_samp("_net").alias("_sd"),
    )
    out = out.withColumn("net_t", F.when(F.col("_sd") > 0, F.col("net_mean_bps") / (F.col("_sd") / F.sqrt("net_n")))).drop("_sd")
    return out.withColumn("net_p", t_two_sided(F.col("net_t"), F.col("net_n") - 1))


def maxlags(horizon_ms: Column, interval_ms: Column) -> Column:
    """Lags over which overlapping labels are related: horizon / interval, rounded up, 1 to 500."""
    return F.when(interval_ms <= 0, F.lit(1)).otherwise(F.least(F.lit(500), F.greatest(F.lit(1), F.ceil(horizon_ms / interval_ms)))).cast("int")


def inverse(matrix: Column, k: int, least: float = 1e-12) -> Column:
    """The inverse of a symmetric positive k by k matrix, both as arrays of rows, by Gauss-Jordan elimination on the matrix
    scaled to a diagonal of ones; null where a pivot is below `least`: its columns depend on each other."""
    width = 2 * k
    at = lambda m, i: F.get(m, i.cast("int") if isinstance(i, Column) else F.lit(i))
    roots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.sqrt(at(matrix, i * (k + 1))))

    def scaled(p: Column) -> Column:
        m, d = p["m"], p["d"]
        cell = lambda i, j: at(m, i * k + j) / (at(d, i) * at(d, j)) if j < k else F.lit(float(j - k == i))
        start = F.array(*[cell(i, j) for i in range(k) for j in range(width)])

        def eliminated(m: Column, pivot: Column) -> Column:
            lead = at(m, pivot * (width + 1))

            def cell(v: Column, i: Column) -> Column:
                row = ((i - i % width) / width).cast("int")
                own = at(m, pivot * width + i % width) / lead
                return F.when(row == pivot, own).otherwise(v - at(m, row * width + pivot) * own)

            return F.when(lead > least, F.transform(m, cell))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, eliminated)
        cells = lambda m: F.array(*[at(m, i * width + k + j) / (at(d, i) * at(d, j)) for i in range(k) for j in range(k)])
        return F.when(done.isNotNull(), F.get(F.transform(F.array(done), cells), F.lit(0)))

    usable = F.forall(roots, lambda d: d > 0)
    return F.when(usable, F.get(F.transform(F.array(F.struct(matrix.alias("m"), roots.alias("d"))), scaled), F.lit(0)))


def hac_regression(cells: DataFrame, controls: list[str], lags: DataFrame, ties: tuple[str, ...] = (), wide: DataFrame | None = None, label: str = "mid") -> DataFrame:
    """Least squares of y on a constant, x and the controls, with Newey-West errors: per cell n, r2, lags, and the arrays beta,
    t and p (normal), the constant first, then x and the controls.

    The normal equations are sums, and solved as columns; so is the Bartlett-weighted covariance of the scores s_t, as
    1/(L+1) * sum of M M' over all sums M of L+1 consecutive scores of a series padded with L zeros (`scores`). So there are two
    passes; the fits between them, a row per cell, go to the tasks by way of the driver, as a broadcast table does. `lags`:
    (coin, horizon_ms, lags). `ties` order the rows of one time. `wide` is the table that long_form made the cells of, with `label`: its
    rows are then shuffled once for all cells of a coin, where the rows of cells are many times as many. Cells with fewer than
    max(30, 5 per coefficient) rows, or whose columns depend on each other, give nulls.
    """
    names = ["const", "x", *controls]
    k = len(names)
    rows = cells if wide is not None else once(cells.select(*CELL, "exch_time_ms", *ties, "x", "y", *controls), "cells")
    d = [F.lit(1.0), *[F.col(c).cast("double") for c in names[1:]]]
    pair = lambda i, j: f"_a{min(i, j)}_{max(i, j)}"
    sums = [F.sum(d[i] * d[j]).alias(pair(i, j)) for i in range(k) for j in range(i, k)] + [F.sum(d[i] * F.col("y")).alias(f"_b{i}") for i in range(k)]
    first = rows.dropna(subset=["x", "y", *controls]).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("_sy"), F.sum(F.col("y") * F.col("y")).alias("_syy"), *sums)
    square = lambda name: F.array(*[F.col(name(i, j)) for i in range(k) for j in range(k)])
    first = first.withColumn("_inverse", F.when(F.col("n") >= max(30, 5 * k), inverse(square(pair), k)))
    of = lambda c, i: F.get(c, F.lit(i))
    beta = F.array(*[sum((of("_inverse", i * k + j) * F.col(f"_b{j}") for j in range(1, k)), of("_inverse", i * k) * F.col("_b0")) for i in range(k)])
    first = first.withColumn("beta", F.when(F.col("_inverse").isNotNull(), beta))
    total, fitted = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n"), sum((of("beta", i) * F.col(f"_b{i}") for i in range(1, k)), of("beta", 0) * F.col("_b0"))
    first = first.withColumn("r2", F.when(total > 0, 1 - (F.col("_syy") - fitted) / total)).select(*CELL, "n", "beta", "r2", "_inverse")
    first = stored(first.join(F.broadcast(lags), ["coin", "horizon_ms"], "left").withColumn("lags", F.when(F.col("beta").isNotNull(), F.col("lags"))), "fits")
    key, told = CELL if wide is None else ["coin"], {}
    for r in first.where("lags is not null").select(*CELL, "lags", "beta").collect():
        at = ("x", "y") if wide is None else (r.feature, f"fwd_logret_{label}_{r.horizon_ms}ms")
        told.setdefault(tuple(r[c] for c in key), []).append(Cell((r.coin, r.feature, r.horizon_ms), *at, r.lags, tuple(r.beta)))
    products = window_products(rows if wide is None else wide, key, ["exch_time_ms", *ties], told, controls, first)
    found = first.join(products, CELL, "left")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    product = lambda i, j: of("_products", upper.index((min(i, j), max(i, j)))) / (F.col("lags") + 1)
    variance = [sum((of("_inverse", i * k + a) * product(a, b) * of("_inverse", b * k + i) for a in range(k) for b in range(k)), F.lit(0.0)) for i in range(k)]
    t = F.array(*[of("beta", i) / F.sqrt(F.greatest(v, F.lit(1e-300))) for i, v in enumerate(variance)])
    found = found.withColumn("t", F.when(F.col("beta").isNotNull(), t)).withColumn("p", F.transform("t", normal_two_sided))
    return found.select(*CELL, "n", "lags", "r2", "beta", "t", "p")
