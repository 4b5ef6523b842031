"""Accounts of given fills: cash, inventory, funding and equity after every event, without a replay.

Inventory, funding rate and oracle price are step functions of time. Fills, funding observations and books are put in one
order, (time, books before fills before funding); running sums and running last values in blocks give the state
after each, and what a step costs is a product of the state before it and the time since. No coin goes through
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import stored
from .blocks import BLOCK_MS, over_history, running
from .events import BOOK, FUNDING, TRADE

HOUR_MS = 3_600_000
#: The order of events of one time and kind is that of `seq`.
ORDER = ["ts_ms", "kind", "seq"]


def account_events(fills: DataFrame, asset_ctx: DataFrame, books: DataFrame | None = None, key: str = "coin", seq: str = "seq") -> DataFrame:
    """(key, ts_ms, kind, seq, signed, paid, rate, oracle, mid) of fills (timestamp_ms, side, price, size, fee and `seq`), of
    funding observations (recv_ts_ns, funding, oracle_px) that have both numbers, and of books (exch_time_ms, recv_ts_ns, mid)."""
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    out = fills.select(key, F.col("timestamp_ms").alias("ts_ms"), F.lit(TRADE).alias("kind"), F.col(seq).cast("long").alias("seq"), signed.alias("signed"), (signed * F.col("price") + F.col("fee")).alias("paid"))
    ctx = asset_ctx.where(F.col("funding").isNotNull() & F.col("oracle_px").isNotNull())
    ctx = ctx.select(key, F.expr("recv_ts_ns div 1000000").alias("ts_ms"), F.lit(FUNDING).alias("kind"), F.col("recv_ts_ns").alias("seq"), F.col("funding").alias("rate"), F.col("oracle_px").alias("oracle"))
    out = out.unionByName(ctx, allowMissingColumns=True)
    if books is None:
        return out.withColumn("mid", F.lit(None).cast("double"))
    marks = books.select(key, F.col("exch_time_ms").alias("ts_ms"), F.lit(BOOK).alias("kind"), F.col("recv_ts_ns").alias("seq"), "mid")
    return out.unionByName(marks, allowMissingColumns=True)


def ledger(events: DataFrame, starting_cash: float, key: str = "coin", block_ms: int = BLOCK_MS) -> DataFrame:
    """account_events with the account after each: cash (less funding), inventory, payment, funding_paid, held_payment, held_paid, equity.

    payment is what a funding observation charges: inventory then, times its oracle price and rate, times the hours since the
    observation before; the first one only starts the clock. held_payment is the same cost charged as it arises: with every event,
    the inventory, price and rate in force before it, times the hours since the event before. Both are 0 on other rows, and paid
    by who is long if positive; funding_paid and held_paid are their sums, and cash is charged the first.
    equity is cash and the inventory at the mid, on books; null elsewhere.
    """
    zero = F.lit(0.0)
    observed = F.when(F.col("kind") == FUNDING, F.struct("ts_ms", "seq", "rate", "oracle"))
    sums = {"inventory": F.coalesce("signed", zero), "_spent": F.coalesce("paid", zero), "_now": observed}
    state = running(events, sums, key, ORDER, "ts_ms", block_ms, {"inventory": F.sum, "_spent": F.sum, "_now": F.max})
    state = stored(state.select(key, *ORDER, "rate", "oracle", "mid", "inventory", "_spent", "_now"), "ledger", narrow=False)
    was = F.struct("ts_ms", "inventory", F.col("_now").alias("now"))
    steps = over_history(state, 1, lambda d, w: d.withColumn("_was", F.lag(was).over(w)), key, ORDER, "ts_ms", block_ms)
    hours = lambda since: (F.col("ts_ms") - since) / HOUR_MS
    charged = F.when(F.col("kind") == FUNDING, F.col("inventory") * F.col("oracle") * F.col("rate") * hours(F.col("_was.now.ts_ms")))
    accrued = F.col("_was.inventory") * F.col("_was.now.oracle") * F.col("_was.now.rate") * hours(F.col("_was.ts_ms"))
    steps = steps.withColumns({"payment": F.coalesce(charged, zero), "held_payment": F.coalesce(accrued, zero)}).drop("_was", "_now", "rate", "oracle")
    paid = running(stored(steps, "payments", narrow=False), {"funding_paid": F.col("payment"), "held_paid": F.col("held_payment")}, key, ORDER, "ts_ms", block_ms)
    cash = F.lit(float(starting_cash)) - F.col("_spent") - F.col("funding_paid")
    paid = paid.withColumn("cash", cash).drop("_spent")
    return paid.withColumn("equity", F.when(F.col("kind") == BOOK, F.col("cash") + F.col("inventory") * F.col("mid")))
