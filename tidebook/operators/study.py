"""The imbalance study: features, strictly later returns, split, and every statistic per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import stored
from . import asof, features, stats

COLUMNS = (
    "coin", "feature", "horizon_ms", "n", "pearson", "pearson_p", "spearman", "spearman_p", "hit_rate", "hit_rate_p", "ols_beta", "ols_p", "ols_r2", "ols_beta_ctrl",
    "ols_p_ctrl", "ols_r2_ctrl", "threshold", "net_mean_bps", "net_pct_positive", "net_n", "net_p",
)


def study(
    books: DataFrame,
    signals: list[str],
    controls: list[str],
    horizons_ms: list[int],
    taker_bps: float,
    depths: tuple[int, ...] = (5, 10, 20),
    train_fraction: float = 0.7,
    quantile: float = 0.75,
    least_rows: int = 50,
    label: str = "mid",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Books of all coins to one row per (coin, feature, horizon) on the test split. Thresholds come from
    the train split alone. One book per time is used, or, with `ties`, all of them in their order. Everything is a column of one DataFrame; stored are the features, the labelled table and the sums, but no cells of books."""
    split = stats.chronological_split(stats.with_history(stored(features.feature_table(books, depths, ties=ties), "features"), least_rows), train_fraction)
    # what is looked at below, and no more, is matched, shuffled and stored
    split = split.select(*dict.fromkeys(["coin", "exch_time_ms", *ties, "is_train", label, *signals, *controls, "spread_bps"]))
    wide = stored(asof.forward_returns(split, horizons_ms, (label,), ties=ties), "labelled", narrow=False)
    long = lambda df: stats.long_form(df, signals, horizons_ms, label, (*controls, *ties))
    test, train = long(wide.where("is_train = false")), long(wide.where("is_train")).where(F.col("horizon_ms") == horizons_ms[0])
    limits = stats.thresholds(train, quantile)
    interval = features.median_interval(wide)
    h = F.explode(F.array(*[F.lit(x).cast("long") for x in horizons_ms])).alias("horizon_ms")
    lags = interval.select("coin", "median_interval_ms", h).select("coin", "horizon_ms", stats.maxlags(F.col("horizon_ms"), F.col("median_interval_ms")).alias("lags"))
    joined = stats.information_coefficient(test, ("exch_time_ms", *ties)).join(stats.directional_accuracy(test), stats.CELL, "left")
    joined = joined.join(stats.net_of_cost(test, limits, taker_bps), stats.CELL, "left").join(limits, ["coin", "feature"], "left")
    for used, suffix in (([], ""), (controls, "_ctrl")):
        fit = stats.hac_regression(test, used, lags, ties, wide.where("is_train = false"), label)
        of_x = [F.get(c, F.lit(1)).alias(f"ols_{c}{suffix}") for c in ("beta", "p")]
        joined = joined.join(fit.select(*stats.CELL, *of_x, F.when(F.col("beta").isNotNull(), F.col("r2")).alias(f"ols_r2{suffix}")), stats.CELL, "left")
    return joined.select(*COLUMNS)
