"""Fills to cash, inventory and average cost; equity curves to risk figures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import stored
from .blocks import BLOCK_MS, over_history, running
from .moments import over_rows, rolling_deviation
from .ranks import quantile

POSITION = ("inventory", "avg_price", "realized", "fees")
YEAR_MS = 365 * 24 * 3_600_000


def cash_and_inventory(fills: DataFrame, starting_cash: float, key: str = "coin", time: str = "timestamp_ms", order: list[str] | None = None, block_ms: int = BLOCK_MS) -> DataFrame:
    """fills (side buy or sell, price, size, fee) with the cash and inventory after each."""
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    out = running(fills, {"_paid": signed * F.col("price") + F.col("fee"), "inventory": signed}, key, order or [time], time, block_ms)
    return out.withColumn("cash", F.lit(starting_cash) - F.col("_paid")).drop("_paid")


def position(fills: Column | str) -> Column:
    """Average-cost position after an ordered array of structs (side, price, size, fee): struct(inventory,
    avg_price, realized, fees). Adding averages the price, reducing realizes against it, and going
    through zero starts at the fill's price; at zero the old price stays until the next fill."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("inventory", "avg_price", "realized", "fees")])

    def apply(p: Column, f: Column) -> Column:
        signed = F.when(f["side"] == "buy", f["size"]).otherwise(-f["size"])
        old, new = p["inventory"], p["inventory"] + signed
        adds = (old == 0) | ((old > 0) == (signed > 0))
        blended = (p["avg_price"] * F.abs(old) + f["price"] * F.abs(signed)) / F.when(F.abs(new) > 0, F.abs(new))
        flipped = (new != 0) & ((new > 0) != (old > 0))
        price = F.when(adds, F.when(old == 0, f["price"]).otherwise(blended)).when(flipped, f["price"]).otherwise(p["avg_price"])
        gain = F.when(adds, F.lit(0.0)).otherwise(F.signum(old) * (f["price"] - p["avg_price"]) * F.least(F.abs(signed), F.abs(old)))
        return F.struct(new.alias("inventory"), price.alias("avg_price"), (p["realized"] + gain).alias("realized"), (p["fees"] + f["fee"]).alias("fees"))

    return F.aggregate(fills, zero, apply)


def positions(fills: DataFrame, key: str = "coin", time: str = "timestamp_ms", order: list[str] | None = None, flat: float = 1e-9, block_ms: int = BLOCK_MS) -> DataFrame:
    """fills (side, price, size, fee) with the average-cost position after each: inventory, avg_price, realized, fees. `order` tells
    all fills of a key apart.

    A position begins where the inventory was 0 or turns over, which its running sum tells (sums within `flat` of 0 are 0); a fill
    that turns it is cut in two, what closes and what opens. The average price depends on nothing before the position's
    beginning, so positions are folded in parallel, each streamed in batches with its size and average carried over;
    what they realized is added up by running sums."""
    order = order or [time]
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    exact = F.col("fee").cast("decimal(28,12)")  # sums of fees do not depend on how they are cut into blocks
    legs = running(fills, {"inventory": signed, "fees": exact}, key, order, time, block_ms).withColumn("fees", F.col("fees").cast("double"))
    zeroed = lambda c: F.when(F.abs(c) < flat, F.lit(0.0)).otherwise(c)
    legs = legs.withColumn("_before", zeroed(F.col("inventory") - signed)).withColumn("inventory", zeroed(F.col("inventory")))
    turns = F.col("_before") * F.col("inventory") < 0
    leg = lambda n, opens, by: F.struct(F.lit(n).alias("_leg"), opens.alias("_opens"), by.alias("_by"))
    whole = F.array(leg(1, F.col("_before") == 0, signed))
    legs = legs.withColumn("_x", F.explode(F.when(turns, F.array(leg(0, F.lit(False), -F.col("_before")), leg(1, F.lit(True), F.col("inventory")))).otherwise(whole)))
    legs = stored(legs.select("*", "_x.*").drop("_x", "_before"), "legs", narrow=False)
    steps = [*order, "_leg"]
    told = running(legs, {"_position": F.col("_opens").cast("long")}, key, steps, time, block_ms)
    schema = T.StructType([*told.schema.fields, T.StructField("avg_price", T.DoubleType()), T.StructField("_gain", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, average = None, 0.0, 0.0
        for batch in batches:
            averages, gains = [], []
            for own in zip(*[batch.column(c).to_pylist() for c in (key, "_position", "_by", "price")], strict=True):
                if own[:2] != at:
                    at, held, average = own[:2], 0.0, 0.0
                by, price = own[2:]
                if held * by >= 0:  # more of it: the average of what is held, and nothing gained
                    held, average, gain = held + by, (held * average + by * price) / (held + by) if held + by else average, 0.0
                else:
                    held, gain = held + by, -by * (price - average)
                averages.append(average)
                gains.append(gain)
            made = [pa.array(averages, pa.float64()), pa.array(gains, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    folded = told.repartition(key, "_position").sortWithinPartitions(key, "_position", *steps).mapInArrow(fold, schema)
    out = running(stored(folded, "positions", narrow=False), {"realized": F.col("_gain")}, key, steps, time, block_ms)
    return out.where("_leg = 1").select(*fills.columns, *POSITION)


def unrealized(position: Column, mark: Column) -> Column:
    return (mark - position["avg_price"]) * position["inventory"]


def equity_changes(curve: DataFrame, key: str = "coin", time: str = "timestamp_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """The curve with change: equity minus that of the row before, in money; null on the first."""
    return over_history(curve, 1, lambda d, w: d.withColumn("change", F.col("equity") - F.lag("equity").over(w)), key, [time], time, block_ms)


def drawdowns(curve: DataFrame, key: str = "coin", time: str = "timestamp_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """The curve with drawdown: how far equity is below its highest so far, as a fraction of 0 or less."""
    top = running(curve, {"_top": F.col("equity")}, key, [time], time, block_ms, how=F.max)
    peak = F.when(F.col("_top") == 0, F.lit(2.220446049250313e-16)).otherwise(F.col("_top"))
    return top.withColumn("drawdown", (F.col("equity") - peak) / peak).drop("_top")


def risk_report(curve: DataFrame, key: str = "coin", time: str = "timestamp_ms", confidence: float = 0.95) -> DataFrame:
    """Per key: updates, sharpe (population deviation, annualized by the updates per year), max_drawdown,
    value_at_risk and expected_shortfall of the changes, as losses. 0 where there are too few rows."""
    curve = stored(curve.select(key, time, "equity"), "curve")
    changed = stored(equity_changes(curve, key, time), "changes")
    stats = changed.groupBy(key).agg(
        F.count("change").alias("n"),
        F.avg("change").alias("_mean"),
        F.stddev_pop("change").alias("_sd"),
        F.greatest((F.max(time) - F.min(time)) / 1000, F.lit(1.0)).alias("_seconds"),
    )
    stats = stored(stats.join(quantile(changed, "change", 1 - confidence, [key]).withColumnRenamed("quantile", "_q"), key, "left"), "risk")
    tail = changed.join(stats.select(key, "_q"), key).where(F.col("change") <= F.col("_q")).groupBy(key).agg(F.avg("change").alias("_tail"))
    deepest = drawdowns(curve, key, time).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))
    all_ = stats.join(deepest, key).join(tail, key, "left")
    per_year = F.col("n") / F.col("_seconds") * (YEAR_MS / 1000)
    zero = F.lit(0.0)
    return all_.select(
        key,
        "n",
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * F.sqrt(per_year)).otherwise(zero).alias("sharpe"),
        F.coalesce("max_drawdown", zero).alias("max_drawdown"),
        F.coalesce(-F.col("_q"), zero).alias("value_at_risk"),
        F.coalesce(-F.col("_tail"), -F.col("_q"), zero).alias("expected_shortfall"),
    )


def inventory_volatility(df: DataFrame, rows: int, key: str = "coin", time: str = "timestamp_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """df with inventory_vol: sample deviation of the inventory over the last `rows` rows, null below
    max(2, rows // 4)."""
    framed = over_rows(df, "inventory", rows, key, [time], time, block_ms)
    return framed.select(*df.columns, rolling_deviation(max(2, rows // 4)).alias("inventory_vol"))


def turnover(fills: DataFrame, key: str = "coin") -> DataFrame:
    return fills.groupBy(key).agg(F.count(F.lit(1)).alias("n_fills"), F.sum(F.col("price") * F.col("size")).alias("turnover_usd"), F.sum("fee").alias("fees_paid"))
