"""Live capture: a streaming source over a message socket, a polling source, and the raw log.

Both sources are Python Data Sources. The connection is made by a factory named `module:function`, so
that tests, and other feeds, bring their own; the default one needs the `websockets` package.

A socket cannot be read again, so what comes from it is written down first: with the option `journal`, a folder,
rows are appended to files there and synced to disk before any batch is planned with them, and stay until their batch is
committed. A process that is started again goes on with the rows that are there.
"""

from __future__ import annotations

import importlib
import json
import logging
import os
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from .raw import CONTEXT_CHANNEL, L2_CHANNEL, PREDICTED_CHANNEL, TRADE_CHANNEL

log = logging.getLogger(__name__)

LOG_SCHEMA = "recv_ts_ns long, channel string, data string"
#: Replies of the server that carry no data.
CONTROL = frozenset({"pong", "subscriptionResponse"})


@dataclass
class Backoff:
    """Waits of base * 2^attempt, at most `most`, plus up to `jitter` seconds."""

    base: float = 1.0
    most: float = 60.0
    jitter: float = 1.0
    attempt: int = 0

    def wait(self) -> float:
        self.attempt += 1
        return min(self.base * 2 ** (self.attempt - 1), self.most) + random.uniform(0, self.jitter)


@dataclass
class Feed:
    """Messages of a socket that is opened again whenever it breaks, however it does: subscriptions are sent on
    every connection, a ping every ping_s; control replies and what is no JSON object are dropped. Counts
    messages, reconnects, malformed ones, and gaps: times of a channel and coin over gap_ms apart."""

    connect: Callable[[str], object]
    url: str
    coins: list[str]
    ping_s: float = 20.0
    backoff: Backoff = field(default_factory=Backoff)
    clock: Callable[[], int] = time.time_ns
    sleep: Callable[[float], None] = time.sleep
    gap_ms: int = 15_000
    messages: int = 0
    reconnects: int = 0
    gaps: int = 0
    malformed: int = 0
    _seen: dict[tuple[str, str], int] = field(default_factory=dict)
    _socket: object = None
    _pinged: float = 0.0

    def subscriptions(self) -> list[str]:
        kinds = (L2_CHANNEL, TRADE_CHANNEL, CONTEXT_CHANNEL)
        return [json.dumps({"method": "subscribe", "subscription": {"type": k, "coin": c}}) for c in self.coins for k in kinds]

    def _open(self):
        if self._socket is None:
            self._socket = self.connect(self.url)
            for s in self.subscriptions():
                self._socket.send(s)
            self._pinged = self.clock() / 1e9
        return self._socket

    def poll(self, most: int, timeout_s: float) -> Iterator[tuple[int, str, str]]:
        """Up to `most` messages, as long as the socket has some."""
        got = 0
        while got < most:
            try:
                socket = self._open()
                if self.clock() / 1e9 - self._pinged >= self.ping_s:
                    socket.send(json.dumps({"method": "ping"}))
                    self._pinged = self.clock() / 1e9
                text = socket.recv(timeout_s)
            except TimeoutError:
                return
            except Exception as e:  # every client closes with an exception of its own
                log.warning("reconnecting after %r", e)
                self._close()
                self.reconnects += 1
                self.sleep(self.backoff.wait())
                continue
            self.backoff.attempt = 0
            try:
                message = json.loads(text)
                channel, data = message.get("channel"), message.get("data")
            except (ValueError, AttributeError):  # no JSON, or no object
                self.malformed += 1
                continue
            if channel is not None and channel not in CONTROL:
                got, self.messages = got + 1, self.messages + 1
                self._count_gap(channel, data)
                yield self.clock(), channel, json.dumps(data)

    def _close(self) -> None:
        socket, self._socket = self._socket, None
        self._seen.clear()  # gaps are those of one connection
        try:
            if hasattr(socket, "close"):
                socket.close()
        except Exception as e:
            log.debug("closing a broken socket: %r", e)

    def _count_gap(self, channel: str, data: object) -> None:
        if isinstance(data, dict) and isinstance(data.get("coin"), str) and isinstance(data.get("time"), int):
            key, at = (channel, data["coin"]), data["time"]
            self.gaps += key in self._seen and at - self._seen[key] > self.gap_ms
            self._seen[key] = at

    def status(self) -> str:
        """One line of what happened so far."""
        return f"messages={self.messages} reconnects={self.reconnects} gaps={self.gaps} malformed={self.malformed}"


def _factory(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def websocket(url: str):
    """The default connection. The client's own keepalive is off: the feed pings by itself."""
    from websockets.sync.client import connect

    return connect(url, ping_interval=None)


class Journal:
    """Numbered rows in files of a folder, each from its number on: `00000000000000000042.jsonl` begins with row 42. `append`
    returns the number after the last; rows are safe after `sync`, which append calls by itself after `sync_rows` of them or
    `sync_s` seconds. What a torn write left of a row at the end is cut off when the folder is opened again. One process
    writes at a time; the folder is on a disk that outlives it."""

    def __init__(self, folder: str, sync_rows: int = 200, sync_s: float = 2.0, file_rows: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.folder, self.sync_rows, self.sync_s, self.file_rows, self.clock = folder, sync_rows, sync_s, file_rows, clock
        os.makedirs(folder, exist_ok=True)
        self.file, self.unsynced, self.synced_at, self.syncs = None, 0, clock(), 0
        starts = self._starts()
        self.first = self.next = starts[0] if starts else 0
        for start in starts:
            good, size = 0, 0
            with open(self._path(start), "rb") as f:
                for line in f:
                    if not line.endswith(b"\n"):
                        break
                    good, size = good + 1, size + len(line)
            if start != self.next:
                raise RuntimeError(f"rows {self.next} to {start} are missing in {folder}")
            if size < os.path.getsize(self._path(start)):
                os.truncate(self._path(start), size)
            self.next = start + good

    def _path(self, start: int) -> str:
        return os.path.join(self.folder, f"{start:020d}.jsonl")

    def _starts(self) -> list[int]:
        return sorted(int(x[:-6]) for x in os.listdir(self.folder) if x.endswith(".jsonl"))

    def append(self, row: tuple) -> int:
        if self.file is None or self.next - self.began >= self.file_rows:
            self.close()
            self.began = self.next
            self.file = open(self._path(self.next), "ab")
            folder = os.open(self.folder, os.O_RDONLY)
            try:
                os.fsync(folder)  # the file's name is on disk too
            finally:
                os.close(folder)
        self.file.write(json.dumps(row).encode() + b"\n")
        self.next += 1
        self.unsynced += 1
        if self.unsynced >= self.sync_rows or self.clock() - self.synced_at >= self.sync_s:
            self.sync()
        return self.next

    def sync(self) -> None:
        if self.file is not None and self.unsynced:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.syncs += 1
        self.unsynced, self.synced_at = 0, self.clock()

    def close(self) -> None:
        self.sync()
        if self.file is not None:
            self.file.close()
        self.file = None

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """The rows from start to before end; an error where some of them are gone."""
        if start < end and (start < self.first or end > self.next):
            raise RuntimeError(f"rows {start} to {end} are asked of {self.folder}, which has {self.first} to {self.next}")
        if self.file is not None:
            self.file.flush()
        starts = self._starts()
        for begin, after in zip(starts, [*starts[1:], self.next], strict=True):
            if begin < end and after > start:
                with open(self._path(begin), encoding="utf-8") as f:
                    for n, line in enumerate(f, begin):
                        if start <= n < end:
                            yield tuple(json.loads(line))

    def forget(self, end: int) -> None:
        """Rows before end are not needed any more: files that have no later ones go, but for the last, which tells the numbers."""
        starts = self._starts()
        for begin, after in zip(starts, starts[1:], strict=False):
            if after <= end:
                os.remove(self._path(begin))
                self.first = after


class Held:
    """The same without a folder, for sources that need not outlive the process."""

    def __init__(self) -> None:
        self.kept: list[tuple] = []
        self.first = self.next = 0

    def append(self, row: tuple) -> int:
        self.kept.append(row)
        self.next += 1
        return self.next

    def sync(self) -> None:
        pass

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        return iter(self.kept[max(0, start - self.first) : max(0, end - self.first)])

    def forget(self, end: int) -> None:
        self.kept, self.first = self.kept[max(0, end - self.first) :], max(end, self.first)


def journal(options: dict[str, str], name: str) -> Journal | Held:
    folder = options.get("journal")
    if folder is None:
        return Held()
    return Journal(os.path.join(folder, name), int(options.get("sync_rows", 200)), float(options.get("sync_s", 2)))


class FeedReader(SimpleDataSourceStreamReader):
    """A batch is what came since the last one, `most` rows at most. Rows are numbered as they are received, and a batch is
    a range of numbers, so one that is planned again has the same rows. With the option `journal` they are on disk before
    the batch is planned, and a reader in a new process first hands on those that were received and not yet planned: every
    row that was synced is in the log once. Without it they are held, and what was not yet in the log is lost when the process ends."""

    def __init__(self, options: dict[str, str]):
        self.options, self.feed = options, None
        self.journal = journal(options, "feed")

    def initialOffset(self) -> dict:
        return {"n": self.journal.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        most = int(self.options.get("most", 10_000))
        if start["n"] >= self.journal.next:  # all that was received is planned
            self._receive(most)
        end = min(self.journal.next, start["n"] + most)
        return iter(list(self.journal.rows(start["n"], end))), {"n": max(end, start["n"])}  # Spark copies the iterator

    def _receive(self, most: int) -> None:
        if self.feed is None:
            o = self.options
            connect = _factory(o.get("connect", "tidebook.sources.capture:websocket"))
            backoff = Backoff(float(o.get("backoff_base_s", 1)), float(o.get("backoff_max_s", 60)), float(o.get("jitter_s", 1)))
            gap_ms = int(1000 * float(o.get("gap_s", 15)))
            self.feed = Feed(connect, o["url"], o["coins"].split(","), float(o.get("ping_s", 20)), backoff, gap_ms=gap_ms)
        for row in self.feed.poll(most, float(self.options.get("timeout_s", 1))):
            self.journal.append(row)
        self.journal.sync()
        log.info("%s", self.feed.status())

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self.journal.rows(start["n"], end["n"])))

    def commit(self, end: dict) -> None:
        self.journal.forget(end["n"])


class MarketFeed(DataSource):
    """spark.readStream.format("market_feed") with options url, coins, ping_s, connect, backoff_base_s,
    backoff_max_s, jitter_s, gap_s, journal, sync_rows, sync_s."""

    @classmethod
    def name(cls) -> str:
        return "market_feed"

    def schema(self) -> str:
        return LOG_SCHEMA

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def post_json(url: str, body: dict) -> list:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=10) as reply:
        return json.load(reply)


class PollReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        fetch = _factory(self.options.get("fetch", "tidebook.sources.capture:post_json"))
        wanted = set(self.options["coins"].split(","))
        data = [x for x in fetch(self.options["url"], {"type": "predictedFundings"}) if x[0] in wanted]
        yield time.time_ns(), PREDICTED_CHANNEL, json.dumps(data)


class PollStream(SimpleDataSourceStreamReader):
    """A poll every every_s seconds; micro-batches in between are empty. Polls are journaled as a feed's rows are."""

    def __init__(self, options: dict[str, str]):
        self.reader, self.every, self.next_ = PollReader(options), float(options.get("every_s", 60)), 0.0
        self.journal = journal(options, "polls")

    def initialOffset(self) -> dict:
        return {"n": self.journal.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["n"] >= self.journal.next and time.monotonic() >= self.next_:
            self.next_ = time.monotonic() + self.every
            for row in self.reader.read(None):
                self.journal.append(row)
            self.journal.sync()
        end = max(self.journal.next, start["n"])
        return iter(list(self.journal.rows(start["n"], end))), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self.journal.rows(start["n"], end["n"])))

    def commit(self, end: dict) -> None:
        self.journal.forget(end["n"])


class FundingPoll(DataSource):
    """format("funding_poll") with options url, coins, fetch: one poll per spark.read, and one every every_s
    seconds on spark.readStream, journaled with the option journal."""

    @classmethod
    def name(cls) -> str:
        return "funding_poll"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> PollReader:
        return PollReader(dict(self.options))

    def simpleStreamReader(self, schema) -> PollStream:
        return PollStream(dict(self.options))


def log_lines(messages: DataFrame) -> DataFrame:
    """Messages as raw log lines with their UTC date and hour."""
    at = F.timestamp_micros(F.expr("recv_ts_ns div 1000"))
    line = F.concat(F.lit('{"recv_ts_ns":'), F.col("recv_ts_ns").cast("string"), F.lit(',"channel":"'), F.col("channel"), F.lit('","data":'), F.col("data"), F.lit("}"))
    return messages.select(line.alias("value"), F.date_format(at, "yyyyMMdd").alias("date"), F.date_format(at, "HH").alias("hour"))


def record(messages: DataFrame, path: str, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Appends the stream to the raw log, in a directory per UTC date and hour."""
    writer = log_lines(messages).writeStream.format("text").partitionBy("date", "hour")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
