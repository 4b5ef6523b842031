"""Windows over a long series without a task per series.

A window over (coin) alone sends each coin's whole history through one task. Here the history is cut
into blocks of time, and each block is given the rows before it that its frames reach back to; a window
over (coin, block) then gives the same values, and the borrowed rows are dropped. Only the counts per
(coin, block), a small table, are ever ordered over a coin's whole life.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..store import once

BLOCK_MS = 86_400_000
BLOCK, BORROWED = "_block", "_borrowed"


def with_block(df: DataFrame, time: str = "exch_time_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(time) / block_ms).cast("long"))


def borrowed_rows(df: DataFrame, rows: int, key: str, order: list[str | Column], time: str, block_ms: int) -> DataFrame:
    """df with a block, and before each block's rows the `rows` rows that precede it."""
    df = with_block(df, time, block_ms).withColumn(BORROWED, F.lit(False))
    life = Window.partitionBy(key).orderBy(BLOCK)
    counts = df.groupBy(key, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    # rows of this key up to and including the block, and before it
    upto = counts.withColumn("_upto", F.sum("_n").over(life)).withColumn("_before", F.col("_upto") - F.col("_n"))
    # a block lends to those after it that start less than `rows` rows behind its end
    near = upto.withColumn("_next", F.collect_list(F.struct(F.col(BLOCK).alias("to"), F.col("_before").alias("start"))).over(life.rowsBetween(1, rows)))
    lends = near.withColumn("_next", F.filter("_next", lambda x: x["start"] < F.col("_upto") + rows)).where(F.size("_next") > 0)
    last = Window.partitionBy(key, BLOCK).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    tail = df.withColumn("_from_end", F.row_number().over(last)).where(F.col("_from_end") <= rows)
    lent = tail.join(lends.select(key, BLOCK, "_upto", "_next"), [key, BLOCK])
    lent = lent.withColumn("_x", F.explode("_next")).where(F.col("_x.start") - (F.col("_upto") - F.col("_from_end") + 1) < rows)
    lent = lent.withColumn(BLOCK, F.col("_x.to")).withColumn(BORROWED, F.lit(True)).select(*df.columns)
    return df.unionByName(lent)


def over_history(
    df: DataFrame, rows: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], key: str = "coin", order: list[str] | None = None, time: str = "exch_time_ms", block_ms: int = BLOCK_MS
) -> DataFrame:
    """compute(df, window) with window = (key, block) in order, for frames of at most `rows` rows back."""
    order = order or [time]
    spread = borrowed_rows(once(df, "history"), rows, key, order, time, block_ms)
    done = compute(spread, Window.partitionBy(key, BLOCK).orderBy(*order))
    return done.where(~F.col(BORROWED)).drop(BLOCK, BORROWED)


def over_lookback(
    df: DataFrame, lookback_ms: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], key: str = "coin", time: str = "exch_time_ms", block_ms: int = BLOCK_MS
) -> DataFrame:
    """As over_history, for frames that reach back a time: rows go to all blocks that start within it."""
    block = with_block(df, time, block_ms)
    ahead = F.floor((F.col(time) + lookback_ms) / block_ms).cast("long")
    spread = block.withColumn("_to", F.explode(F.sequence(F.col(BLOCK), ahead)))
    spread = spread.withColumn(BORROWED, F.col("_to") != F.col(BLOCK)).withColumn(BLOCK, F.col("_to")).drop("_to")
    done = compute(spread, Window.partitionBy(key, BLOCK).orderBy(time))
    return done.where(~F.col(BORROWED)).drop(BLOCK, BORROWED)


def running(
    df: DataFrame, sums: dict[str, Column], key: str = "coin", order: list[str] | None = None, time: str = "exch_time_ms", block_ms: int = BLOCK_MS,
    how: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] = F.sum,
) -> DataFrame:
    """Running sums (or maxima, with how=F.max; how may tell them apart by name) over a key's whole history, this row
    included: within the block, and on top of it that of the blocks before. The maximum of structs that begin with
    the time is the last one."""
    order = order or [time]
    hows = how if isinstance(how, dict) else dict.fromkeys(sums, how)
    df = with_block(once(df, "running"), time, block_ms).withColumns({f"_v_{k}": v for k, v in sums.items()})
    totals = df.groupBy(key, BLOCK).agg(*[hows[k](F.col(f"_v_{k}")).alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, BLOCK, *[hows[k](F.col(f"_t_{k}")).over(before).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({k: hows[k](F.col(f"_v_{k}")).over(within) for k in sums}).join(totals, [key, BLOCK])
    joined = {k: F.coalesce(F.col(k) + F.col(f"_b_{k}"), F.col(k)) if hows[k] is F.sum else F.greatest(k, f"_b_{k}") for k in sums}
    return df.withColumns(joined).drop(BLOCK, *[f"_{x}_{k}" for k in sums for x in "vb"])
