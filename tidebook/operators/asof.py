"""As-of matching by union, sort and a running last value, in blocks of time.

A range join would compare every pair near in time; here each side is read once. Within a block the last
observation before (or first after) a query is found by a running value; queries that find none in
their block take the nearest block's, from a table with a row per (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.book import ln
from ..store import once
from .blocks import BLOCK, BLOCK_MS, with_block


def asof(queries: DataFrame, observed: DataFrame, values: list[str], key: str, at: str, time: str, direction: str, ties: list[str] | None = None, block_ms: int = BLOCK_MS) -> DataFrame:
    """queries with `values` of the latest observation at or before queries[at] (`backward`), or of the
    first at or after it (`forward`); null where there is none. `ties` order observations of one time:
    backward takes the last, forward the first. Of the observations only these columns are read, and stored where they are not
    a scan; that happens as the plan is built."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    ties, ahead = ties or [], direction == "forward"
    found = F.struct(*[F.col(v).alias(v) for v in values])
    queries, observed = once(queries, "queries"), once(observed.select(*dict.fromkeys([key, time, *ties, *values])), "observed")
    q = with_block(queries.withColumn("_at", F.col(at)), "_at", block_ms)
    o = with_block(observed.select(key, F.col(time).alias("_at"), *[F.col(t).alias(f"_tie_{t}") for t in ties], found.alias("_found")), "_at", block_ms)
    # ahead: from the latest on, so that the observation is met first; at one time before the query
    by: list[Column] = [F.desc("_at") if ahead else F.asc("_at"), F.asc("_is_query"), *[(F.desc if ahead else F.asc)(f"_tie_{t}") for t in ties]]
    both = q.withColumn("_is_query", F.lit(1)).unionByName(o.withColumn("_is_query", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key, BLOCK).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_match", F.last("_found", ignorenulls=True).over(w)).where("_is_query = 1")
    edge = F.min if ahead else F.max
    edges = o.groupBy(key, BLOCK).agg(edge(F.struct("_at", *[f"_tie_{t}" for t in ties], "_found")).alias("_edge"))
    # every (key, block) that has a query gets the edge of the nearest block with observations beyond it
    places = q.select(key, BLOCK).distinct().join(edges, [key, BLOCK], "full_outer")
    life = Window.partitionBy(key).orderBy(F.desc(BLOCK) if ahead else F.asc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    places = places.select(key, BLOCK, F.last("_edge", ignorenulls=True).over(life)["_found"].alias("_beyond"))
    done = both.join(places, [key, BLOCK], "left").withColumn("_match", F.coalesce("_match", "_beyond"))
    return done.select(*queries.columns, *[F.col("_match")[v].alias(v) for v in values])


def forward_returns(df: DataFrame, horizons_ms: list[int], prices: tuple[str, ...] = ("mid", "microprice"), block_ms: int = BLOCK_MS, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with fwd_logret_{price}_{h}ms: log of the first price at or after t + h over the price now; null
    where no book is that late. `ties` order books of one time. All horizons go through one match."""
    df = once(df, "priced")
    h = F.array(*[F.lit(int(x)).cast("long") for x in horizons_ms])
    slim = df.select("coin", "exch_time_ms", F.explode(h).alias("_h")).withColumn("_target", F.col("exch_time_ms") + F.col("_h"))
    later = df.select("coin", "exch_time_ms", *ties, *[F.col(p).alias(f"_fwd_{p}") for p in prices])
    matched = asof(slim, later, [f"_fwd_{p}" for p in prices], "coin", "_target", "exch_time_ms", "forward", list(ties), block_ms)
    each = [F.max(F.when(F.col("_h") == x, F.col(f"_fwd_{p}"))).alias(f"_fwd_{p}_{x}") for x in horizons_ms for p in prices]
    wide = matched.groupBy("coin", "exch_time_ms").agg(*each)
    df = df.join(wide, ["coin", "exch_time_ms"])
    now = {p: ln(p) for p in prices}
    new = {f"fwd_logret_{p}_{x}ms": ln(f"_fwd_{p}_{x}") - now[p] for x in horizons_ms for p in prices}
    return df.withColumns(new).drop(*[f"_fwd_{p}_{x}" for x in horizons_ms for p in prices])


def forward_index(df: DataFrame, horizon_ms: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """(coin, exch_time_ms, idx, fwd_idx): row numbers per coin from 0, and that of the first row at or
    after t + h; the number of rows where there is none."""
    from .blocks import running

    numbered = running(df.select("coin", "exch_time_ms"), {"_nth": F.lit(1).cast("long")}, block_ms=block_ms).withColumn("idx", F.col("_nth") - 1).drop("_nth")
    target = numbered.withColumn("_target", F.col("exch_time_ms") + horizon_ms)
    found = asof(target, numbered.select("coin", "exch_time_ms", F.col("idx").alias("fwd_idx")), ["fwd_idx"], "coin", "_target", "exch_time_ms", "forward", ["fwd_idx"], block_ms)
    total = numbered.groupBy("coin").agg(F.count(F.lit(1)).alias("_total"))
    return found.join(total, "coin").select("coin", "exch_time_ms", "idx", F.coalesce("fwd_idx", "_total").alias("fwd_idx"))


def book_before_trade(trades: DataFrame, books: DataFrame, values: list[str], block_ms: int = BLOCK_MS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Trades with values of the latest book at or before them: at one time the book comes first. `ties` order
    books that were received together."""
    return asof(trades, books, values, "coin", "exch_time_ms", "exch_time_ms", "backward", ["recv_ts_ns", *ties], block_ms)


def latest_funding(asset_ctx: DataFrame, predicted: DataFrame, venue: str) -> DataFrame:
    """Per coin the latest current rate and the latest predicted rate of the venue, with their APRs."""
    from ..functions.rates import annualized

    now = asset_ctx.groupBy("coin").agg(F.max_by("funding", "recv_ts_ns").alias("current"))
    next_ = predicted.where(F.col("venue") == venue).groupBy("coin").agg(F.max_by("funding_rate", "recv_ts_ns").alias("predicted"))
    both = now.join(next_, "coin", "full_outer")
    return both.withColumns({"current_apr": annualized("current"), "predicted_apr": annualized("predicted")})
