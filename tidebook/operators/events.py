"""The replay's event stream, and books kept up by level updates."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..store import once
from .blocks import BLOCK, BLOCK_MS, with_block

#: Order of kinds at one time.
BOOK, TRADE, FUNDING = 0, 1, 2


def merged_events(books: DataFrame, trades: DataFrame, asset_ctx: DataFrame) -> DataFrame:
    """One table of the three inputs: ts_ms, kind, seq, and each input's columns. The order is (ts_ms,
    kind, recv_ts_ns, seq); funding has receive times only."""
    b = books.withColumns({"ts_ms": F.col("exch_time_ms"), "kind": F.lit(BOOK), "seq": F.lit(0).cast("long")})
    t = trades.withColumns({"ts_ms": F.col("exch_time_ms"), "kind": F.lit(TRADE), "seq": F.col("tid")})
    f = asset_ctx.withColumns({"ts_ms": F.expr("recv_ts_ns div 1000000"), "kind": F.lit(FUNDING), "seq": F.lit(0).cast("long")})
    return b.unionByName(t, allowMissingColumns=True).unionByName(f, allowMissingColumns=True)


def book_from_updates(updates: DataFrame, n: int = 20) -> DataFrame:
    """Level updates (coin, side, price, size, seq) to books (coin, bids, asks): the last size of each
    price, 0 meaning the level is gone; at most n levels, best first."""
    last = updates.groupBy("coin", "side", "price").agg(F.max_by("size", "seq").alias("size")).where("size <> 0")
    sign = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    best = last.withColumn("_rank", F.row_number().over(Window.partitionBy("coin", "side").orderBy(sign))).where(F.col("_rank") <= n)
    level = F.struct("_rank", F.col("price").alias("px"), F.col("size").alias("sz"))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, level))), lambda x: F.struct(x["px"].alias("px"), x["sz"].alias("sz")))
    return best.groupBy("coin").agg(side("bid").alias("bids"), side("ask").alias("asks"))


class Ladder:
    """One side of a book: sizes by price, and the prices in order, bids by their negatives, so that the best come first."""

    def __init__(self, sign: int):
        self.sign, self.sizes, self.order = sign, {}, []

    def put(self, price: float, size: float | None) -> None:
        """The level's new size; 0 or none removes it."""
        rank = self.sign * price
        if not size:
            if self.sizes.pop(price, None) is not None:
                self.order.pop(bisect_left(self.order, rank))
            return
        if price not in self.sizes:
            insort(self.order, rank)
        self.sizes[price] = size

    def best(self, n: int) -> tuple[list[float], list[float]]:
        prices = [self.sign * x for x in self.order[:n]]
        return prices, [self.sizes[p] for p in prices]


def opening_levels(updates: DataFrame, time: str = "exch_time_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """The levels that each block of a coin's updates begins with: (coin, _block, side, price, size). Of every price the last size in
    a block holds until the next block that has the price; it is handed to the blocks from there to that one, if it
    is not 0, so there are as many rows as the books have levels at the blocks' starts."""
    life = Window.partitionBy("coin").orderBy(BLOCK)
    nth = updates.select("coin", BLOCK).distinct().withColumn("_nth", F.row_number().over(life))
    last = updates.groupBy("coin", BLOCK, "side", "price").agg(F.max_by("size", "seq").alias("size")).join(nth, ["coin", BLOCK])
    count = nth.groupBy("coin").agg(F.max("_nth").alias("_count"))
    until = F.lead("_nth").over(Window.partitionBy("coin", "side", "price").orderBy("_nth"))
    last = last.withColumn("_until", until).join(count, "coin").withColumn("_until", F.coalesce("_until", "_count"))
    held = last.where((F.col("size") != 0) & (F.col("_until") > F.col("_nth")))
    held = held.select("coin", "side", "price", "size", F.explode(F.sequence(F.col("_nth") + 1, F.col("_until"))).alias("_nth"))
    return held.join(nth, ["coin", "_nth"]).select("coin", BLOCK, "side", "price", "size")


def book_history(updates: DataFrame, n: int = 5, time: str = "exch_time_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """Level updates (coin, side bid or ask, price, size, seq, and a time that does not fall with seq) to the book after each:
    (coin, seq, bid_px, bid_sz, ask_px, ask_sz), at most n levels a side, best first. A size of 0 or null removes the level.

    Blocks of time go in parallel: each begins with the levels that the blocks before have left, and its own updates are
    folded on them in the order of seq. A task holds one block's live levels, whatever the number of updates. Updates without
    coin, side or price are left out; of updates with one seq, prices follow in order.
    """
    known = updates.where(F.col("side").isin("bid", "ask") & F.col("coin").isNotNull() & F.col("price").isNotNull())
    known = once(known.select("coin", "side", F.col("price").cast("double").alias("price"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"), "seq", time), "updates")
    blocked = with_block(known, time, block_ms).drop(time)
    both = opening_levels(blocked, time, block_ms).withColumn("seq", F.lit(None).cast(blocked.schema["seq"].dataType)).unionByName(blocked)
    order = ["coin", BLOCK, F.asc_nulls_first("seq"), "side", "price"]
    dealt = both.select("coin", BLOCK, "side", "price", "size", "seq").repartition("coin", BLOCK).sortWithinPartitions(*order)
    ladders = [T.StructField(f"{s}_{c}", T.ArrayType(T.DoubleType())) for s in ("bid", "ask") for c in ("px", "sz")]
    schema = T.StructType([blocked.schema["coin"], blocked.schema["seq"], *ladders])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, {}
        for batch in batches:
            rows: list[tuple] = []
            for coin, block, side, price, size, seq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (coin, block) != at:
                    at, sides = (coin, block), {"bid": Ladder(-1), "ask": Ladder(1)}
                sides[side].put(price, size)
                if seq is not None:
                    rows.append((coin, seq, *sides["bid"].best(n), *sides["ask"].best(n)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, batch.schema.field(5).type, *[pa.list_(pa.float64())] * 4], strict=False)] if rows else None
            if made:
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return dealt.mapInArrow(folded, schema)
