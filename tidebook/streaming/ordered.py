"""Windows and as-of matches on streams: rows are kept per key until the watermark has passed them, and released in order.

Micro-batches bring rows late and out of order. A keyed buffer holds them; an event-time timer at the earliest one fires
once the watermark is past it, and then all rows up to the watermark are handed on, sorted, together with what
their computation carries over from earlier ones (the last rows of a window, the labels that wait, the last book). So
a computation sees each key's rows once and in order, and is a function over two small frames. What the buffer holds
is bounded by the watermark's delay, what is carried over by the window. Rows that come after the watermark has passed them
are dropped. The state store has to be RocksDB (`with_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.book import top, with_microprice, with_spread
from ..functions.liquidity import with_depth

#: (carried rows, released rows in order) to (results, rows to carry on).
Work = Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]
TIME = "exch_time_ms"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state with lists and timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _rows(df: pd.DataFrame, names: list[str]) -> list[tuple]:
    """Plain values, None for missing ones."""
    columns = [[None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in df[n].tolist()] for n in names]
    return list(zip(*columns, strict=True)) if len(df) else []


class InOrder(StatefulProcessor):
    """Buffers rows of `columns` per key and gives `work` those that the watermark has passed, by time and then by `ties`."""

    def __init__(self, key: str, columns: T.StructType, carried: T.StructType, out: T.StructType, ties: list[str], work: Work):
        self.key, self.columns, self.carried, self.out, self.ties, self.work = key, columns, carried, out, ties, work

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.columns)
        self.carry = handle.getListState("carry", self.carried)
        self.upto = handle.getValueState("upto", T.StructType([T.StructField("at", T.LongType())]))

    def _released(self) -> int:
        return self.upto.get()[0] if self.upto.exists() else -(1 << 62)

    def _empty(self) -> pd.DataFrame:
        return pd.DataFrame({f.name: pd.Series(dtype="object") for f in self.out.fields})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, released, first = self.columns.names, self._released(), None
        for batch in rows:
            batch = batch[batch[TIME] > released]
            if len(batch):
                self.pending.appendList(_rows(batch, names))
                least = int(batch[TIME].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first, 0))
        yield self._empty()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names, mark = self.columns.names, timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.pending.get()), columns=names) if self.pending.exists() else pd.DataFrame(columns=names)
        ready = held[held[TIME] <= mark].sort_values([TIME, *self.ties], kind="stable").reset_index(drop=True)
        if not len(ready):
            yield self._empty()
            return
        rest = held[held[TIME] > mark]
        if len(rest):
            self.pending.put(_rows(rest, names))
            self.handle.registerTimer(int(rest[TIME].min()))
        else:
            self.pending.clear()
        self.upto.update((max(int(mark), self._released()),))
        carried = pd.DataFrame(list(self.carry.get()) if self.carry.exists() else [], columns=self.carried.names)
        found, carry = self.work(carried, ready)
        if len(carry):
            self.carry.put(_rows(carry, self.carried.names))
        else:
            self.carry.clear()
        found = found.copy()
        found.insert(0, self.key, key[0])
        yield found[self.out.names]

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, columns: str, carried: str, out: str, work: Work, ties: list[str], late: str = "10 seconds", key: str = "coin") -> DataFrame:
    """The stream (key, exch_time_ms, columns...) through `work`, key by key. `late` is how far behind the latest time a row may come."""
    parse = lambda ddl: T.StructType([T.StructField(*_field(x)) for x in ddl.split(", ")])
    whole = parse(f"{key} string, {out}")
    names = [TIME, *[c.split()[0] for c in columns.split(", ")]]
    rows = stream.select(key, *names, F.timestamp_millis(TIME).alias("_at")).withWatermark("_at", late)
    processor = InOrder(key, parse(f"{TIME} long, {columns}"), parse(carried), whole, ties, work)
    return rows.groupBy(key).transformWithStateInPandas(processor, whole, "append", "EventTime")


def _field(text: str) -> tuple[str, T.DataType]:
    name, kind = text.split()
    return name, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[kind]


def features(books: DataFrame, lookback: int = 20, bps: float = 10.0, window_rows: int = 300, drought_z: float = -2.5, late: str = "10 seconds") -> DataFrame:
    """Books to the flow and liquidity features of each, one per coin and time (the first received): ofi, log_ret_1, realized_vol,
    momentum, depth, liquidity_z, liquidity_drought, as of `operators.features.with_flow` and `liquidity_signal`."""
    depth = f"depth_within_{int(bps)}bps"
    slim = with_depth(with_spread(books), bps).withColumns({"depth": F.col(depth), "bid_sz0": top("bid_sz"), "ask_sz0": top("ask_sz")})
    columns = "recv_ts_ns long, best_bid double, best_ask double, bid_sz0 double, ask_sz0 double, mid double, depth double"
    keep = max(lookback + 1, window_rows)

    def work(carried: pd.DataFrame, ready: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        fresh = ready.drop_duplicates(TIME)
        df = (pd.concat([carried, fresh]) if len(carried) else fresh).reset_index(drop=True)
        numbers = df[["best_bid", "best_ask", "bid_sz0", "ask_sz0", "mid", "depth"]].astype("float64")
        bid, ask, bid_sz, ask_sz, mid, d = (numbers[c] for c in numbers)

        def moved(price: pd.Series, size: pd.Series, better: int) -> np.ndarray:
            was, before = price.shift(), size.shift()
            return np.select([better * (price - was) > 0, price == was, better * (price - was) < 0], [size, size - before, -before], np.nan)

        ret = np.log(mid.where(mid > 0)).diff()
        roll = lambda x, n: x.rolling(n, min_periods=max(2, n // 4))
        spread = roll(d, window_rows).std()
        z = ((d - roll(d, window_rows).mean()) / spread).where(spread > 1e-12)
        out = pd.DataFrame(
            {
                TIME: df[TIME], "ofi": moved(bid, bid_sz, 1) - moved(ask, ask_sz, -1), "log_ret_1": ret, "realized_vol": roll(ret, lookback).std(), "momentum": roll(ret, lookback).sum(),
                "depth": d, "liquidity_z": z, "liquidity_drought": (z < drought_z),
            }
        )
        return out.iloc[len(carried) :], df.tail(keep)

    out = f"{TIME} long, ofi double, log_ret_1 double, realized_vol double, momentum double, depth double, liquidity_z double, liquidity_drought boolean"
    return in_order(slim, columns, f"{TIME} long, {columns}", out, work, ["recv_ts_ns"], late)


def forward_returns(books: DataFrame, horizons_ms: list[int], late: str = "10 seconds") -> DataFrame:
    """Books to labels (coin, exch_time_ms, horizon_ms, fwd_logret_mid, fwd_logret_microprice), each once a book at or after t + h is
    released: the first such book's price over the price at t. Until then it waits in the state; books are one per coin and time."""
    slim = with_microprice(with_spread(books))
    horizons = np.array(sorted(horizons_ms), np.int64)

    def work(carried: pd.DataFrame, ready: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        fresh = ready.drop_duplicates(TIME).reset_index(drop=True)
        asked = fresh.loc[fresh.index.repeat(len(horizons)), [TIME, "mid", "microprice"]].reset_index(drop=True)
        asked["horizon_ms"] = np.tile(horizons, len(fresh))
        waiting = pd.concat([carried, asked]) if len(carried) else asked
        waiting = waiting.astype({TIME: "int64", "horizon_ms": "int64", "mid": "float64", "microprice": "float64"}).reset_index(drop=True)
        times = fresh[TIME].to_numpy(np.int64)
        at = np.searchsorted(times, waiting[TIME].to_numpy() + waiting["horizon_ms"].to_numpy())
        due = at < len(times)
        out = waiting[due].copy()
        log = lambda x: np.log(np.where(x > 0, x, np.nan))
        for price in ("mid", "microprice"):
            later = fresh[price].astype("float64").to_numpy()[at[due]]
            out[f"fwd_logret_{price}"] = log(later) - log(out[price].to_numpy())
        return out, waiting[~due]

    columns = "recv_ts_ns long, mid double, microprice double"
    return in_order(slim, columns, f"{TIME} long, horizon_ms long, mid double, microprice double", f"{TIME} long, horizon_ms long, fwd_logret_mid double, fwd_logret_microprice double", work, ["recv_ts_ns"], late)


def book_before_trade(trades: DataFrame, books: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Trades (coin, exch_time_ms, recv_ts_ns, tid, px, sz) with mid and book_ms of the latest book at or before them; null before
    the first. Both streams go into one keyed buffer, in which a book comes before a trade of its time; of books only the last is carried on."""
    b = with_spread(books).select("coin", TIME, "recv_ts_ns", F.lit(0).alias("kind"), "mid", *[F.lit(None).cast(t).alias(c) for c, t in (("tid", "long"), ("px", "double"), ("sz", "double"))])
    t = trades.select("coin", TIME, "recv_ts_ns", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("mid"), "tid", "px", "sz")
    both = b.unionByName(t).withColumn("tid", F.coalesce("tid", F.lit(-1).cast("long")))

    def work(carried: pd.DataFrame, ready: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        df = (pd.concat([carried, ready]) if len(carried) else ready).reset_index(drop=True)
        is_book = (df["kind"] == 0).to_numpy()
        last = np.maximum.accumulate(np.where(is_book, np.arange(len(df)), -1))
        found = last >= 0
        mids, times = df["mid"].astype("float64").to_numpy(), df[TIME].astype("float64").to_numpy()
        df = df.assign(mid=np.where(found, mids[last], np.nan), book_ms=np.where(found, times[last], np.nan))
        return df[~is_book], df.iloc[[last[-1]]] if found[-1] else df.iloc[:0]

    columns = "recv_ts_ns long, kind int, mid double, tid long, px double, sz double"
    return in_order(both, columns, f"{TIME} long, {columns}", f"{TIME} long, tid long, px double, sz double, mid double, book_ms double", work, ["kind", "recv_ts_ns", "tid"], late)
