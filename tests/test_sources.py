from __future__ import annotations

import json

import pytest

from tidebook import config
from tidebook.sources import capture, normalize, raw, sinks

LEVEL = lambda p, s, n: {"px": p, "sz": s, "n": n}
L2 = {"recv_ts_ns": 1_704_067_200_000_000_000, "channel": "l2Book", "data": {"coin": "BTC", "time": 77, "levels": [[LEVEL("2417.25", "0.75", 6), LEVEL("2416.5", "3.2", 11), LEVEL("2415.75", "8", 2)], [LEVEL("2418.75", "4.4", 9)]]}}
TRADES = {"recv_ts_ns": 2, "channel": "trades", "data": [{"coin": "BTC", "side": s, "px": p, "sz": "2.25", "time": 78, "hash": "0xfe", "tid": i} for i, (s, p) in enumerate((("A", "2417.25"), ("B", "2418.75"), ("B", "2419")))]}
CTX = {"recv_ts_ns": 3, "channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"funding": "-0.00031", "oraclePx": "2417.9", "midPx": None, "markPx": "n/a"}}}
POLL = {"recv_ts_ns": 4, "channel": "predictedFundingsPoll", "data": [["BTC", [["HlPerp", {"fundingRate": "0.00044", "nextFundingTime": 90061}], ["X", None]]], ["ETH", []]]}


def put(path, *messages):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages))


def test_parse(spark, tmp_path):
    put(tmp_path / "20240101" / "00.jsonl", L2, "", "not json", TRADES, CTX, POLL, {"channel": "other", "data": {}, "recv_ts_ns": 1})
    lines = raw.read_raw(spark, str(tmp_path))
    book = raw.l2book(lines).first()
    assert book.bid_px == [2417.25, 2416.5, 2415.75] and book.bid_sz[2] == 8.0 and book.ask_n == [9] and book.exch_time_ms == 77
    assert [(t.side, t.px) for t in raw.trades(lines).orderBy("tid").collect()] == [("A", 2417.25), ("B", 2418.75), ("B", 2419.0)]
    ctx = raw.asset_ctx(lines).first()
    assert ctx.funding == -0.00031 and ctx.mid_px is None and ctx.mark_px is None and ctx.oracle_px == 2417.9
    assert [tuple(r) for r in raw.predicted_funding(lines).collect()] == [("BTC", "HlPerp", 0.00044, 90061, 0, 4)]


def test_normalize_is_incremental(spark, tmp_path):
    log, out = tmp_path / "raw", str(tmp_path / "out")
    put(log / "20240101" / "00.jsonl", L2, TRADES)
    put(log / "20240101" / "01.jsonl", L2, CTX, POLL)
    first = normalize.normalize(spark, str(log), out)
    assert first.rows == {"l2book": 2, "trades": 3, "asset_ctx": 1, "predicted_funding": 1} and len(first.files) == 2
    assert normalize.normalize(spark, str(log), out).files == []
    put(log / "20240101" / "00.jsonl", L2, L2, TRADES)
    second = normalize.normalize(spark, str(log), out)
    assert second.files == ["20240101/00.jsonl"]
    assert normalize.read_table(spark, out, "l2book", ["BTC"]).count() == 3 and normalize.read_table(spark, out, "trades").count() == 3
    put(log / "20240101" / "01.jsonl", "")
    normalize.normalize(spark, str(log), out)
    assert {(r.date, r.hour) for r in normalize.read_table(spark, out, "l2book").collect()} == {("20240101", "00")}
    assert normalize.read_table(spark, out, "asset_ctx").count() == 0


def test_a_dead_job_leaves_the_tables_as_they_were(spark, tmp_path):
    """Killed between any two steps, readers see the old tables, never half of the new ones; run again, all of them."""
    log, out = tmp_path / "raw", str(tmp_path / "out")
    rows = lambda: {t: sorted(map(str, normalize.read_table(spark, out, t).collect())) for t in normalize.TABLES}
    put(log / "20240101" / "00.jsonl", L2, TRADES)
    normalize.normalize(spark, str(log), out)
    for n in range(1, 4):
        put(log / "20240101" / "00.jsonl", *[L2] * (n + 1), TRADES, CTX)
        put(log / "20240101" / f"0{n}.jsonl", L2, POLL)
        before, kept, step, seen = rows(), normalize.read_table(spark, out, "l2book"), 0, []
        while "commit" not in seen[-1:]:
            step, seen = step + 1, []
            for name in normalize.steps(spark, str(log), out, normalize.Outcome()):
                seen.append(name)
                if len(seen) == step:
                    break  # the job dies here
            if seen[-1] != "commit":
                assert rows() == before
        assert seen == ["raw", "l2book", "trades", "asset_ctx", "predicted_funding", "commit"]
        now = rows()
        assert {t: len(v) for t, v in now.items()} == {"l2book": n + 1 + n, "trades": 3, "asset_ctx": 1, "predicted_funding": n}
        assert kept.count() == len(before["l2book"])  # a reader that began before goes on with what it saw
    assert normalize.vacuum(spark, out, keep=1) > 0 and rows() == now
    assert normalize.vacuum(spark, out, keep=1) == 0 and normalize.commits(normalize.Files(spark), out) == [4]


def test_two_jobs_do_not_make_the_same_commit(spark, tmp_path):
    log, out = tmp_path / "raw", str(tmp_path / "out")
    put(log / "20240101" / "00.jsonl", L2)
    slow = normalize.steps(spark, str(log), out, normalize.Outcome())
    next(slow)
    normalize.normalize(spark, str(log), out)
    with pytest.raises(RuntimeError):
        list(slow)
    assert normalize.read_table(spark, out, "l2book").count() == 1


def test_statistics_of_row_groups_skip_other_coins(spark, tmp_path):
    """An hour is many tasks and is sorted by coin: a scan for one coin has its filter pushed down and reads a part of the rows."""
    coins, n = [f"C{i:02d}" for i in range(16)], 400
    times = 1_704_067_200_000
    book = lambda c, i: {"recv_ts_ns": (times + i) * 1_000_000, "channel": "l2Book", "data": {"coin": c, "time": times + i, "levels": [[{"px": str(100 - k + i / 7), "sz": "1", "n": 1} for k in range(20)]] * 2}}
    put(tmp_path / "raw" / "20240101" / "00.jsonl", *[book(c, i) for i in range(n) for c in coins])
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        normalize.normalize(spark, str(tmp_path / "raw"), out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = list((tmp_path / "out" / "l2book").rglob("*.parquet"))
    assert len(files) > 1
    df = normalize.read_table(spark, out, "l2book", ["C03"])
    plan = df._jdf.queryExecution().executedPlan()
    assert "EqualTo(coin,C03)" in plan.toString() and df.collect() and df.count() == n
    scan = plan
    df._jdf.queryExecution().toRdd().count()
    while not scan.children().isEmpty():
        scan = scan.children().head()
    read = scan.metrics().get("numOutputRows").get().value()
    assert n <= read < n * len(coins) / 3, (read, len(files))


class Socket:
    """Breaks after each list of replies but the last, which times out."""

    script: list[list[str]] = []
    sent: list[str] = []

    def __init__(self, url):
        self.replies = iter(Socket.script.pop(0))

    def send(self, text):
        Socket.sent.append(text)

    def recv(self, timeout):
        reply = next(self.replies, None)
        if reply is None:
            raise OSError("closed") if Socket.script else TimeoutError
        return reply


def test_feed_reconnects_and_drops_control():
    Socket.script, Socket.sent = [['{"channel":"pong"}', '{"channel":"trades","data":[1]}'], ['{"channel":"l2Book","data":{}}']], []
    waits = []
    feed = capture.Feed(Socket, "ws://x", ["BTC", "ETH"], backoff=capture.Backoff(jitter=0.0), sleep=waits.append)
    got = list(feed.poll(10, 0.1))
    assert [g[1] for g in got] == ["trades", "l2Book"] and waits == [1.0] and feed.reconnects == 1 and feed.messages == 2
    assert len(Socket.sent) == 12 and json.loads(Socket.sent[0])["subscription"] == {"type": "l2Book", "coin": "BTC"}


class ClosedByPeer(Exception):
    """Such as a client library's own, which is no OSError."""


class Foreign(Socket):
    closed = 0

    def recv(self, timeout):
        reply = next(self.replies, None)
        if reply is None:
            raise ClosedByPeer if Socket.script else TimeoutError
        return reply

    def close(self):
        Foreign.closed += 1
        raise ClosedByPeer


def test_feed_survives_foreign_exceptions_and_junk():
    book = lambda t: json.dumps({"channel": "l2Book", "data": {"coin": "ETH", "time": t}})
    Socket.script, Socket.sent = [[book(0), "{broken", "7", book(90_000)], [book(500_000), book(500_001)]], []
    feed = capture.Feed(Foreign, "ws://x", ["ETH"], sleep=lambda s: None)
    assert len(list(feed.poll(10, 0.1))) == 4
    assert (feed.malformed, feed.reconnects, feed.gaps, Foreign.closed) == (2, 1, 1, 1) and "gaps=1" in feed.status()


def test_a_pings_time_has_come():
    Socket.script, Socket.sent, now = [[json.dumps({"channel": "trades", "data": []})] * 3], [], iter(range(0, 10**12, 9 * 10**9))
    list(capture.Feed(Socket, "ws://x", [], ping_s=20.0, clock=lambda: next(now)).poll(10, 0.1))
    assert Socket.sent and set(Socket.sent) == {json.dumps({"method": "ping"})}


def test_a_batch_that_is_planned_again_has_its_rows():
    Socket.script = [[json.dumps({"channel": "trades", "data": [i]}) for i in range(5)]]
    reader = capture.FeedReader({"url": "ws://x", "coins": "BTC", "connect": f"{__name__}:Socket", "most": "3"})
    rows, end = reader.read({"n": 0})
    rows, (more, last) = list(rows), reader.read(end)
    assert list(reader.readBetweenOffsets({"n": 0}, end)) == rows and len(rows) == 3
    reader.commit(end)
    assert list(reader.readBetweenOffsets({"n": 0}, end)) == [] and list(reader.readBetweenOffsets(end, last)) == list(more)


def trade(i):
    return json.dumps({"channel": "trades", "data": [i]})


def test_a_new_process_gets_every_synced_row_once(tmp_path):
    options = {"url": "ws://x", "coins": "BTC", "connect": f"{__name__}:Socket", "most": "4", "journal": str(tmp_path)}
    Socket.script = [[trade(i) for i in range(10)]]
    reader = capture.FeedReader(options)
    first, end = reader.read(reader.initialOffset())
    planned, last = reader.read(end)  # planned, and then the process dies before it is committed
    first, planned = list(first), list(planned)
    reader.commit(end)
    reader._receive(100)  # received and synced, but in no batch yet
    Socket.script = [[trade(i) for i in range(10, 12)]]
    again = capture.FeedReader(options)
    assert list(again.readBetweenOffsets(end, last)) == planned
    left, upto = again.read(last)
    left = list(left)
    new, _ = again.read(upto)
    assert [json.loads(r[2])[0] for r in first + planned + left + list(new)] == list(range(12))


def test_journal_cuts_torn_rows_and_forgets_files(tmp_path):
    now = [0.0]
    j = capture.Journal(str(tmp_path / "a"), sync_rows=3, sync_s=5.0, file_rows=4, clock=lambda: now[0])
    for i in range(9):
        assert j.append((i, "é")) == i + 1
    assert j.syncs == 2 + 2  # every third row, and when a file is full
    now[0] = 6.0
    j.append((9, "é"))
    assert j.syncs == 5 and j.unsynced == 0
    with open(tmp_path / "a" / f"{8:020d}.jsonl", "ab") as f:
        f.write(b'[10, "torn')
    k = capture.Journal(str(tmp_path / "a"))
    assert (k.first, k.next) == (0, 10) and list(k.rows(3, 10)) == [(i, "é") for i in range(3, 10)]
    k.append((10, "ü"))
    k.forget(8)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == [f"{8:020d}.jsonl", f"{10:020d}.jsonl"] and list(k.rows(8, 11))[-1] == (10, "ü")
    with pytest.raises(RuntimeError):
        list(k.rows(7, 9))
    k.forget(11)
    k.close()
    assert capture.Journal(str(tmp_path / "a")).next == 11  # the numbers go on
    (tmp_path / "a" / f"{20:020d}.jsonl").write_text("[20]\n")
    with pytest.raises(RuntimeError):
        capture.Journal(str(tmp_path / "a"))


def test_polls_are_due_after_a_while():
    reader = capture.PollStream({"url": "u", "coins": "BTC", "fetch": f"{__name__}:fetched", "every_s": "3600"})
    rows, end = reader.read({"n": 0})
    assert len(list(rows)) == 1 and end == {"n": 1} and len(list(reader.readBetweenOffsets({"n": 0}, end))) == 1
    rows, again = reader.read(end)
    assert list(rows) == [] and again == end


def test_a_recorded_stream_is_normalized(spark, tmp_path):
    """From the log of a stream, over two hours and a restart of the query, to every row of the tables."""
    put_in = lambda i, rows: spark.createDataFrame(rows, capture.LOG_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    t0 = 1_704_067_200_000_000_000
    for i in range(2):
        put_in(i, [(t0 + i * 3_600 * 10**9 + k, c, json.dumps(m["data"])) for k, (c, m) in enumerate((("l2Book", L2), ("trades", TRADES), ("activeAssetCtx", CTX), ("predictedFundingsPoll", POLL)))])
        stream = spark.readStream.schema(capture.LOG_SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = capture.record(stream, f"{tmp_path}/raw", f"{tmp_path}/raw/_checkpoints", "1 second")
        q.processAllAvailable()
        q.stop()
    done = normalize.normalize(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert done.rows == {"l2book": 2, "trades": 6, "asset_ctx": 2, "predicted_funding": 2}
    assert normalize.normalize(spark, f"{tmp_path}/raw", f"{tmp_path}/out").files == []
    books = normalize.read_table(spark, f"{tmp_path}/out", "l2book", ["BTC"])
    assert {(r.date, r.hour) for r in books.collect()} == {("20240101", "00"), ("20240101", "01")}
    plan = books.where("date = '20240101' and hour = '01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and ("In(coin, [BTC])" in plan or "EqualTo(coin,BTC)" in plan)


def test_backoff():
    b = capture.Backoff(1.0, 60.0, 0.0)
    assert [b.wait() for _ in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]


def fetched(url, body):
    return [["BTC", []], ["DOGE", []]]


def test_funding_poll(spark):
    reader = capture.PollReader({"url": "u", "coins": "BTC,ETH", "fetch": f"{__name__}:fetched"})
    ((_, channel, data),) = list(reader.read(None))
    assert channel == "predictedFundingsPoll" and json.loads(data) == [["BTC", []]]


def test_log_lines_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(1_704_070_799_999_999_999, "trades", json.dumps(TRADES["data"]))], capture.LOG_SCHEMA)
    lines = capture.log_lines(m)
    assert (lines.first().date, lines.first().hour) == ("20240101", "00")
    assert raw.trades(raw.envelope(lines)).count() == 3


def test_record_stream(spark, tmp_path):
    m = spark.createDataFrame([(1_704_070_800_000_000_000 + i, "l2Book", json.dumps(L2["data"])) for i in range(3)], capture.LOG_SCHEMA)
    m.write.parquet(f"{tmp_path}/in")
    q = capture.record(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/c", "1 second")
    q.processAllAvailable()
    q.stop()
    assert raw.l2book(raw.read_raw(spark, f"{tmp_path}/log/date=20240101/hour=01")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("BTC", 0.5)], "coin string, pearson double")
    sinks.write_csv(df, f"{tmp_path}/results_csv")
    sinks.write_json(df, f"{tmp_path}/results_json")
    assert sinks.read_results(spark, f"{tmp_path}/results_csv").collect() == df.collect() == sinks.read_results(spark, f"{tmp_path}/results_json").collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("symbols: [BTC]\nfees: {maker_bps: 2.0}\n")
    s = config.load(str(tmp_path / "c.yaml"), {"TIDEBOOK_WS_URL": "ws://y"})
    assert s.symbols == ("BTC",) and s.fees.maker_bps == 2.0 and s.fees.taker_bps == 4.5 and s.capture.ws_url == "ws://y"
    (tmp_path / "bad.json").write_text('{"fees": {"other": 1}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.json"), {})


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(json.dumps(L2),), ("{broken",)], "value string")
    plan = raw.l2book(raw.envelope(lines)).select("coin", "bid_px")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("json_tuple(") == 1 and "get_json_object" not in plan
