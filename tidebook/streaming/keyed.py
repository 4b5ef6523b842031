"""Keyed state on streams: gaps, latest funding, and books kept up by updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.book import with_spread

NONE = GroupStateTimeout.NoTimeout


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, which are held: the source's limit on a trigger (maxFilesPerTrigger,
    maxOffsetsPerTrigger) bounds them."""
    parts = list(batches)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame(columns=by)


def gaps(messages: DataFrame, threshold_ms: int) -> DataFrame:
    """Messages (channel, coin, exch_time_ms) that come more than the threshold after the latest before
    them on their channel, also across micro-batches. A late message is no gap."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in _in_order(batches, ["exch_time_ms"])["exch_time_ms"]:
            if last is not None and t - last > threshold_ms:
                out.append((*key, int(t), int(t - last)))
            last = max(int(t), last) if last is not None else int(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["channel", "coin", "exch_time_ms", "gap_ms"])

    return messages.groupBy("channel", "coin").applyInPandasWithState(find, "channel string, coin string, exch_time_ms long, gap_ms long", "last long", "append", NONE)


def latest_funding(updates: DataFrame, venue: str) -> DataFrame:
    """Updates (coin, venue, rate, recv_ts_ns; a null venue means the current rate) to the latest current
    and predicted rate per coin, whenever one changes. Only that venue's predictions count."""

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, now_ns, ahead, ahead_ns = state.get if state.exists else (None, -1, None, -1)
        for row in _in_order(batches, ["recv_ts_ns"]).itertuples():
            if pd.isna(row.venue) and row.recv_ts_ns >= now_ns:
                now, now_ns = float(row.rate), int(row.recv_ts_ns)
            elif row.venue == venue and row.recv_ts_ns >= ahead_ns:
                ahead, ahead_ns = float(row.rate), int(row.recv_ts_ns)
        state.update((now, now_ns, ahead, ahead_ns))
        yield pd.DataFrame({"coin": [key[0]], "current": [now], "predicted": [ahead]}).astype({"current": "float64", "predicted": "float64"})

    return updates.groupBy("coin").applyInPandasWithState(
        track, "coin string, current double, predicted double", "now double, now_ns long, ahead double, ahead_ns long", "update", NONE
    )


def books(updates: DataFrame, n: int = 20) -> DataFrame:
    """Level updates (coin, side, price, size, seq) to the coin's book after each micro-batch: at most n
    levels a side, best first. A size of 0 removes the level."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sides = {"bid": {}, "ask": {}}
        if state.exists:
            bp, bs, ap, as_ = state.get
            sides = {"bid": dict(zip(bp, bs, strict=True)), "ask": dict(zip(ap, as_, strict=True))}
        for row in _in_order(batches, ["seq"]).itertuples():
            if row.size == 0:
                sides[row.side].pop(row.price, None)
            else:
                sides[row.side][row.price] = row.size
        flat = [list(x) for s in ("bid", "ask") for x in (sides[s].keys(), sides[s].values())]
        state.update(tuple(flat))
        best = {"bid": sorted(sides["bid"].items(), reverse=True)[:n], "ask": sorted(sides["ask"].items())[:n]}
        yield pd.DataFrame({"coin": [key[0]]} | {f"{s}_{c}": [[x[i] for x in best[s]]] for s in ("bid", "ask") for i, c in enumerate(("px", "sz"))})

    doubles = "array<double>"
    return updates.groupBy("coin").applyInPandasWithState(
        keep,
        f"coin string, bid_px {doubles}, bid_sz {doubles}, ask_px {doubles}, ask_sz {doubles}",
        f"bp {doubles}, bs {doubles}, ap {doubles}, as_ {doubles}",
        "update",
        NONE,
    )


def spread_by_window(stream: DataFrame, late: str = "10 seconds", width: str = "1 minute") -> DataFrame:
    """Mean spread and number of books per coin and window of receive time; later books are dropped."""
    at = F.timestamp_micros(F.expr("recv_ts_ns div 1000"))
    df = with_spread(stream).withColumn("at", at).withWatermark("at", late)
    return df.groupBy(F.window("at", width).alias("w"), "coin").agg(F.count(F.lit(1)).alias("n"), F.avg("spread_bps").alias("spread_bps")).select("w.start", "coin", "n", "spread_bps")


class CaptureStats(StreamingQueryListener):
    """Messages and rate of the running queries."""

    def __init__(self) -> None:
        self.messages, self.rate, self.batches, self.ended = 0, 0.0, 0, 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        self.messages += event.progress.numInputRows
        self.rate = event.progress.processedRowsPerSecond
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended += 1
