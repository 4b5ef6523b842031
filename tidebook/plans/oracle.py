"""SQL for DuckDB, written apart from the Spark plans: plain windows over (coin), as-of joins, lists."""

from __future__ import annotations

HORIZONS = (60_000, 300_000, 600_000, 1_800_000, 3_600_000)
FEATURES = ("tob_imbalance", "imbalance_d5", "imbalance_d10", "imbalance_d20", "ofi")

BASE = """
WITH base AS (
  SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'SOL' END AS coin,
         epoch_us(ts) // 1000 AS exch_time_ms, CAST(round(value * 100) AS BIGINT) AS v
  FROM events),
walk AS (
  SELECT *, 20000 + CAST(sum(v % 5 - 2) OVER (PARTITION BY coin ORDER BY event_id) AS BIGINT) AS bid_tick, 1 + event_id % 3 AS spr FROM base),
l2book AS (
  SELECT event_id, coin, exch_time_ms, exch_time_ms * 1000000 AS recv_ts_ns,
         [(bid_tick - i) * 0.5::DOUBLE FOR i IN range(0, 20)] AS bid_px,
         [(1 + (event_id * 31 + i * 17 + v * 7) % 97) / 8.0::DOUBLE FOR i IN range(0, 20)] AS bid_sz,
         [(bid_tick + spr + i) * 0.5::DOUBLE FOR i IN range(0, 20)] AS ask_px,
         [(1 + (event_id * 37 + i * 13 + v * 11) % 97) / 8.0::DOUBLE FOR i IN range(0, 20)] AS ask_sz
  FROM walk),
trades AS (
  SELECT coin, CASE WHEN v % 2 = 0 THEN 'A' ELSE 'B' END AS side,
         CASE WHEN v % 2 = 0 THEN (bid_tick - v % 3) * 0.5::DOUBLE ELSE (bid_tick + spr + v % 3) * 0.5::DOUBLE END AS px,
         (1 + v % 128) / 8.0::DOUBLE AS sz, exch_time_ms + 1 AS exch_time_ms, (exch_time_ms + 1) * 1000000 AS recv_ts_ns, event_id AS tid
  FROM walk),
asset_ctx AS (
  SELECT coin, exch_time_ms * 1000000 + 2000000 AS recv_ts_ns, (event_id % 21 - 10) / 1048576.0::DOUBLE AS funding,
         (2 * bid_tick + spr) * 0.25::DOUBLE AS oracle_px FROM walk WHERE event_id % 10 = 0),
predicted AS (
  SELECT coin, venue, funding + o / 1048576.0::DOUBLE AS funding_rate, (recv_ts_ns // 3600000000000) * 3600000 + 3600000 AS next_funding_time_ms,
         h AS funding_interval_hours, recv_ts_ns
  FROM asset_ctx, (VALUES ('HlPerp', 0, 1), ('BinPerp', 1, 8), ('BybitPerp', 2, 8)) t(venue, o, h)),
sp AS (
  SELECT *, bid_px[1] AS best_bid, ask_px[1] AS best_ask, (bid_px[1] + ask_px[1]) / 2 AS mid, ask_px[1] - bid_px[1] AS spread_abs,
         CASE WHEN bid_px[1] + ask_px[1] <> 0 THEN (ask_px[1] - bid_px[1]) / ((bid_px[1] + ask_px[1]) / 2) * 10000 END AS spread_bps
  FROM l2book),
top AS (
  SELECT *, CASE WHEN bid_sz[1] + ask_sz[1] <> 0 THEN (best_bid * ask_sz[1] + best_ask * bid_sz[1]) / (bid_sz[1] + ask_sz[1]) ELSE mid END AS microprice,
         CASE WHEN bid_sz[1] + ask_sz[1] <> 0 THEN (bid_sz[1] - ask_sz[1]) / (bid_sz[1] + ask_sz[1]) ELSE 0 END AS tob_imbalance
  FROM sp)"""


def _depth(n: int, scheme: str = "linear_decay") -> str:
    weight = {"linear_decay": f"({n} - i)", "uniform": "1", "exp_decay": "pow(0.5::DOUBLE, i)"}[scheme]
    dot = lambda c: f"list_sum([{c}[i + 1] * {weight} FOR i IN range(0, {n})])"
    b, a = dot("bid_sz"), dot("ask_sz")
    return f"CASE WHEN {b} + {a} <> 0 THEN ({b} - {a}) / ({b} + {a}) ELSE 0 END"


def _vwap(side: str, size: float) -> str:
    before = f"coalesce(list_sum({side}_sz[1:i]), 0)"
    got = f"greatest(0, least({side}_sz[i + 1], {size} - {before}))"
    return f"(list_sum([{side}_px[i + 1] * {got} FOR i IN range(0, 20)]) / list_sum([{got} FOR i IN range(0, 20)]))"


def _within(bps: float) -> str:
    return (
        f"list_sum([CASE WHEN mid - bid_px[i] <= mid * {bps} / 10000 THEN bid_sz[i] ELSE 0 END FOR i IN range(1, 21)]) + "
        f"list_sum([CASE WHEN ask_px[i] - mid <= mid * {bps} / 10000 THEN ask_sz[i] ELSE 0 END FOR i IN range(1, 21)])"
    )


FLOW = """,
lagged AS (
  SELECT *, lag(best_bid) OVER w AS pb, lag(best_ask) OVER w AS pa, lag(bid_sz[1]) OVER w AS pbs, lag(ask_sz[1]) OVER w AS pas,
         ln(mid) - ln(lag(mid) OVER w) AS log_ret_1
  FROM top WINDOW w AS (PARTITION BY coin ORDER BY exch_time_ms)),
flow AS (
  SELECT *, CASE WHEN best_bid > pb THEN bid_sz[1] WHEN best_bid = pb THEN bid_sz[1] - pbs WHEN best_bid < pb THEN -pbs END
          - CASE WHEN best_ask < pa THEN ask_sz[1] WHEN best_ask = pa THEN ask_sz[1] - pas WHEN best_ask > pa THEN -pas END AS ofi,
         CASE WHEN count(log_ret_1) OVER w >= 5 THEN stddev_samp(log_ret_1) OVER w END AS realized_vol,
         CASE WHEN count(log_ret_1) OVER w >= 5 THEN sum(log_ret_1) OVER w END AS momentum
  FROM lagged WINDOW w AS (PARTITION BY coin ORDER BY exch_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

ZSCORE = f""",
dep AS (SELECT event_id, coin, exch_time_ms, {_within(5)} AS d FROM sp),
z AS (
  SELECT event_id, coin, d, CASE WHEN count(d) OVER w >= 15 AND stddev_samp(d) OVER w > 0 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w END AS z
  FROM dep WINDOW w AS (PARTITION BY coin ORDER BY exch_time_ms ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""

SIGMA = """,
mids AS (
  SELECT *, list(mid) OVER (PARTITION BY coin ORDER BY exch_time_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS m FROM top),
sig AS (
  SELECT *, CASE WHEN len(m) < 3 THEN 0 ELSE list_stddev_pop([m[i + 1] - m[i] FOR i IN range(1, len(m))]) END AS sigma FROM mids)"""

FORWARD = """,
q AS (SELECT event_id, coin, exch_time_ms, mid, microprice, h, exch_time_ms + h AS target FROM top, (SELECT unnest([{hs}]) AS h)),
fwd AS (
  SELECT q.event_id, q.coin, q.h, ln(t.mid) - ln(q.mid) AS mid_ret, ln(t.microprice) - ln(q.microprice) AS micro_ret
  FROM q ASOF LEFT JOIN top t ON q.coin = t.coin AND q.target <= t.exch_time_ms)""".format(hs=", ".join(map(str, HORIZONS)))

CELLS = (
    FLOW
    + FORWARD
    + f""",
feats AS (
  SELECT *, {_depth(5)} AS imbalance_d5, {_depth(10)} AS imbalance_d10, {_depth(20)} AS imbalance_d20,
         exch_time_ms <= min(exch_time_ms) OVER (PARTITION BY coin) + 0.7::DOUBLE * (max(exch_time_ms) OVER (PARTITION BY coin) - min(exch_time_ms) OVER (PARTITION BY coin)) AS is_train
  FROM flow),
long AS (
  SELECT event_id, coin, feature, x, is_train, spread_bps FROM (
    {" UNION ALL ".join(f"SELECT event_id, coin, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, is_train, spread_bps FROM feats" for f in FEATURES)})),
cells AS (
  SELECT event_id, l.coin, l.feature, f.h AS horizon_ms, l.x, f.mid_ret AS y, l.spread_bps FROM long l JOIN fwd f USING (event_id) WHERE NOT l.is_train)"""
)
HCELLS = """,
lag_of AS (
  SELECT coin, h AS horizon_ms, CAST(least(500, greatest(1, ceil(h / m))) AS INT) AS lags
  FROM (SELECT coin, quantile_cont(CAST(d AS DOUBLE), 0.5) AS m FROM (SELECT coin, exch_time_ms - lag(exch_time_ms) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS d FROM l2book) GROUP BY coin),
       (SELECT unnest([{hs}]::BIGINT[]) AS h))""".format(hs=", ".join(map(str, HORIZONS)))
CONTROLS = ("spread_bps", "realized_vol", "momentum")


def _hac(tag: str, controls: tuple[str, ...]) -> str:
    """Table hac{tag}: least squares with the covariance summed lag by lag; the matrix is inverted step by step."""
    k, cell = 2 + len(controls), "coin, feature, horizon_ms"
    names = ["1", "x", *controls]
    out = f""",
d{tag} AS MATERIALIZED (
  SELECT {cell}, row_number() OVER (PARTITION BY {cell} ORDER BY exch_time_ms) AS i, [{", ".join(f"CAST({n} AS DOUBLE)" for n in names)}] AS d, y
  FROM (SELECT * EXCLUDE (spread_bps) FROM cells) JOIN feats USING (event_id, coin) WHERE {" AND ".join(f"{n} IS NOT NULL" for n in ("y", *names[1:]))}),
n{tag} AS (SELECT {cell}, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM d{tag} GROUP BY ALL),
b{tag} AS MATERIALIZED (SELECT {cell}, r, sum(d[r] * y) AS v FROM d{tag}, range(1, {k + 1}) t(r) GROUP BY ALL),
g{tag}_0 AS MATERIALIZED (
  SELECT {cell}, r, c, sum(CASE WHEN c <= {k} THEN d[r] * d[c] END) AS v FROM d{tag}, range(1, {k + 1}) t(r), range(1, {k + 1}) u(c) GROUP BY ALL
  UNION ALL SELECT {cell}, r, {k} + c, CAST(r = c AS DOUBLE) FROM n{tag}, range(1, {k + 1}) t(r), range(1, {k + 1}) u(c))"""
    for p in range(1, k + 1):
        g = f"g{tag}_{p - 1}"
        out += f""",
g{tag}_{p} AS MATERIALIZED (
  SELECT {cell}, m.r, m.c, CASE WHEN m.r = {p} THEN m.v / l.v ELSE m.v - o.v * w.v / l.v END AS v
  FROM {g} m JOIN (SELECT {cell}, v FROM {g} WHERE r = {p} AND c = {p}) l USING ({cell}) JOIN (SELECT {cell}, r, v FROM {g} WHERE c = {p}) o USING ({cell}, r)
       JOIN (SELECT {cell}, c, v FROM {g} WHERE r = {p}) w USING ({cell}, c))"""
    return out + f""",
v{tag} AS MATERIALIZED (SELECT {cell}, r, c - {k} AS c, v FROM g{tag}_{k} WHERE c > {k}),
e{tag} AS (SELECT {cell}, list(v ORDER BY r) AS beta FROM (SELECT {cell}, v.r, sum(v.v * b.v) AS v FROM v{tag} v JOIN b{tag} b USING ({cell}) WHERE b.r = v.c GROUP BY ALL) GROUP BY ALL),
s{tag} AS MATERIALIZED (
  SELECT {cell}, i, list_transform(d, lambda x: x * (y - list_sum(list_transform(list_zip(d, beta), lambda z: z[1] * z[2])))) AS s FROM d{tag} JOIN e{tag} USING ({cell})),
m{tag} AS (
  SELECT {cell}, r, c, sum((1 - l / (lags + 1)) * (CASE WHEN l = 0 THEN a.s[r] * b.s[c] ELSE a.s[r] * b.s[c] + a.s[c] * b.s[r] END)) AS v
  FROM (SELECT {cell}, s, lags, l, i - l AS i FROM s{tag} JOIN lag_of USING (coin, horizon_ms), unnest(range(lags + 1)) q(l)) a
       JOIN s{tag} b USING ({cell}, i), range(1, {k + 1}) t(r), range(1, {k + 1}) u(c) GROUP BY ALL),
w{tag} AS (
  SELECT {cell}, sum(p.v * m.v * q.v) AS var FROM m{tag} m JOIN v{tag} p USING ({cell}) JOIN v{tag} q USING ({cell})
  WHERE p.r = 2 AND p.c = m.r AND q.r = m.c AND q.c = 2 GROUP BY ALL),
f{tag} AS (SELECT {cell}, sum(beta[r] * v) AS fitted FROM b{tag} JOIN e{tag} USING ({cell}) GROUP BY ALL),
hac{tag} AS (
  SELECT {cell}, n, CASE WHEN n >= {max(30, 5 * k)} THEN beta[2] END AS beta, CASE WHEN n >= {max(30, 5 * k)} THEN beta[2] / sqrt(var) END AS t,
         CASE WHEN n >= {max(30, 5 * k)} THEN 1 - (syy - fitted) / (syy - sy * sy / n) END AS r2
  FROM n{tag} JOIN e{tag} USING ({cell}) JOIN w{tag} USING ({cell}) JOIN f{tag} USING ({cell}))"""


def _normal_p(z: str) -> str:
    """Both tails, by the series of positive terms of the error function."""
    x = f"(abs({z}) / sqrt(2))"
    terms = f"list_sum(list_transform(range(300), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) - lgamma(2 * k + 2) + lgamma(k + 1))))"
    return f"CASE WHEN abs({z}) > 9 THEN 0 WHEN {z} = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms} END"


def _t_p(square: str, df: str) -> str:
    """Both tails of Student's t with whole degrees of freedom, by its finite sums; square is t^2 / (df + t^2)."""
    c = f"(ln(1 - {square}) / 2)"
    odd = f"list_sum(list_transform(range(CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp((2 * k + 1) * {c} + lgamma(k + 1) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2))))"
    even = f"list_sum(list_transform(range(CAST({df} // 2 AS BIGINT)), lambda k: exp(2 * k * {c} + lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2)))"
    return f"CASE WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * (asin(sqrt({square})) + sqrt({square}) * coalesce({odd}, 0)) ELSE 1 - sqrt({square}) * {even} END"


def _corr_p(r: str) -> str:
    return _t_p(f"({r} * {r})", "(n - 2)")


#: The exact test of an even chance, outcome by outcome.
HIT_P = """CASE WHEN 2 * hits = hit_n THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(CAST(least(hits, hit_n - hits) + 1 AS BIGINT)),
                lambda i: exp(lgamma(hit_n + 1) - lgamma(i + 1) - lgamma(hit_n - i + 1) - hit_n * ln(2))))) END"""
IC = """,
pairs AS (SELECT * FROM cells WHERE x IS NOT NULL AND y IS NOT NULL),
pair_ranks AS (
  SELECT *, rank() OVER (PARTITION BY coin, feature, horizon_ms ORDER BY x) + (count(*) OVER (PARTITION BY coin, feature, horizon_ms, x) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY coin, feature, horizon_ms ORDER BY y) + (count(*) OVER (PARTITION BY coin, feature, horizon_ms, y) - 1) / 2 AS ry FROM pairs),
ic AS (
  SELECT coin, feature, horizon_ms, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(x, y) END AS pearson, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS spearman
  FROM pair_ranks GROUP BY ALL)"""
HITS = """,
hit AS (
  SELECT coin, feature, horizon_ms, count(*) AS hit_n, CAST(sum(CAST(sign(x) = sign(y) AS INT)) AS BIGINT) AS hits FROM cells WHERE x <> 0 AND y <> 0 GROUP BY ALL)"""
NET = """,
th AS (SELECT coin, feature, quantile_cont(abs(x), 0.75) AS threshold FROM long WHERE is_train GROUP BY ALL),
nb AS (SELECT coin, feature, horizon_ms, y * 10000 * sign(x) - (spread_bps + 9) AS net FROM cells JOIN th USING (coin, feature) WHERE abs(x) > threshold AND y IS NOT NULL),
nt AS (
  SELECT coin, feature, horizon_ms, count(*) AS net_n, avg(net) AS net_mean_bps, avg(CAST(net > 0 AS INT)) AS net_pct_positive,
         CASE WHEN stddev_samp(net) > 0 THEN avg(net) / (stddev_samp(net) / sqrt(count(*))) END AS net_t FROM nb GROUP BY ALL)"""
NET_P = _t_p("(net_t * net_t / (net_n - 1 + net_t * net_t))", "(net_n - 1)")
SIGNED = """,
fl AS (SELECT *, CASE WHEN side = 'A' THEN sz ELSE -sz END AS signed, abs(px * sz) * 1.5 / 10000 AS fee FROM trades)"""
LEDGER = """,
ev AS (
  SELECT coin, exch_time_ms AS ts, 1 AS kind, tid AS seq, signed, signed * px + fee AS paid, NULL AS ob, NULL AS mid FROM fl
  UNION ALL SELECT coin, recv_ts_ns // 1000000, 2, recv_ts_ns, 0, 0, {'ts': recv_ts_ns // 1000000, 'rate': funding, 'px': oracle_px}, NULL FROM asset_ctx
  UNION ALL SELECT coin, exch_time_ms, 0, recv_ts_ns, 0, 0, NULL, mid FROM sp),
st AS (
  SELECT *, sum(signed) OVER w AS inventory, sum(paid) OVER w AS spent, last_value(ob IGNORE NULLS) OVER w AS now
  FROM ev WINDOW w AS (PARTITION BY coin ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pv AS (SELECT *, lag(ts) OVER w AS ts0, lag(inventory) OVER w AS inv0, lag(now) OVER w AS now0 FROM st WINDOW w AS (PARTITION BY coin ORDER BY ts, kind, seq)),
py AS (
  SELECT *, CASE WHEN kind = 2 THEN coalesce(inventory * ob.px * ob.rate * (ts - now0.ts) / 3600000, 0) ELSE 0 END AS payment,
         coalesce(inv0 * now0.px * now0.rate * (ts - ts0) / 3600000, 0) AS held FROM pv),
led AS (
  SELECT *, sum(payment) OVER w AS funding_paid, sum(held) OVER w AS held_paid FROM py WINDOW w AS (PARTITION BY coin ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
CURVE = """,
curve AS (SELECT event_id, coin, exch_time_ms, 100.0::DOUBLE + mid - 10000 AS equity FROM sp),
ch AS (SELECT *, equity - lag(equity) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS change,
              max(equity) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS peak FROM curve)"""


def _sql(body: str, *more: str) -> str:
    return BASE + "".join(more) + "\n" + body


ORACLE_SQL: dict[str, str] = {
    "spread_imbalance_by_coin": _sql("SELECT coin, count(*) AS n, round(avg(spread_bps), 6) AS avg_spread_bps, round(avg(tob_imbalance), 6) AS avg_imbalance FROM top GROUP BY coin"),
    "spread_summary": _sql("SELECT event_id, coin, best_bid, best_ask, mid, spread_abs, round(spread_bps, 8) AS spread_bps FROM sp"),
    "microprice": _sql("SELECT event_id, coin, round(microprice, 8) AS microprice, round((microprice - mid) / mid * 10000, 8) + 0.0 AS microprice_dev_bps FROM top"),
    "tob_imbalance": _sql("SELECT event_id, coin, round(tob_imbalance, 8) + 0.0 AS tob_imbalance FROM top"),
    "slippage_buy": _sql("SELECT event_id, coin, " + ", ".join(f"round(({_vwap('ask', s)} - mid) / mid * 10000, 8) AS slippage_bps_{s}" for s in (5, 40, 200)) + " FROM sp"),
    "slippage_sell": _sql(
        f"SELECT event_id, coin, least(40.0::DOUBLE, list_sum(bid_sz)) AS filled_size, list_sum(bid_sz) >= 40 AS fully_filled, round({_vwap('bid', 40)}, 8) AS vwap, "
        f"round(-({_vwap('bid', 40)} - mid) / mid * 10000, 8) AS slippage_bps FROM sp"
    ),
    "depth_within_bps": _sql(f"SELECT event_id, coin, {_within(2)} AS depth_within_2bps, {_within(5)} AS depth_within_5bps FROM sp"),
    "funding_apr": _sql("SELECT coin, recv_ts_ns, funding, round(pow(1 + funding, 8760) - 1, 6) + 0.0 AS funding_apr FROM asset_ctx"),
    "funding_payment": _sql("SELECT coin, recv_ts_ns, round(2.5::DOUBLE * oracle_px * funding, 8) + 0.0 AS payment FROM asset_ctx"),
    "fees": _sql("SELECT tid, coin, round(px * sz * 1.5 / 10000, 8) AS maker_fee, round(px * sz * 4.5 / 10000, 8) AS taker_fee FROM trades"),
    "tick_size": _sql("SELECT event_id, coin, list_min([ask_px[i + 1] - ask_px[i] FOR i IN range(1, 20)]) AS tick_size FROM l2book"),
    "round_to_tick": _sql("SELECT event_id, coin, floor(microprice / 0.5) * 0.5::DOUBLE AS bid_tick_px, ceil(microprice / 0.5) * 0.5::DOUBLE AS ask_tick_px FROM top"),
    "dedup_books": _sql("SELECT DISTINCT ON (coin, exch_time_ms) coin, exch_time_ms, recv_ts_ns, bid_sz[1] AS bid_sz0 FROM l2book ORDER BY coin, exch_time_ms, recv_ts_ns"),
    "top_levels": _sql("SELECT event_id, coin, " + ", ".join(f"{s}_{f}[{i + 1}] AS {s[0]}{i}_{f}" for s in ("bid", "ask") for i in range(3) for f in ("px", "sz")) + ", bid_px[1] >= ask_px[1] AS crossed FROM l2book"),
    "book_from_updates": _sql(
        """SELECT coin, side, CAST(level AS INT) AS level, px, sz FROM (
             SELECT coin, side, px, sz, row_number() OVER (PARTITION BY coin, side ORDER BY CASE WHEN side = 'bid' THEN -px ELSE px END) - 1 AS level
             FROM (SELECT coin, CASE WHEN side = 'A' THEN 'bid' ELSE 'ask' END AS side, px, arg_max(CASE WHEN sz < 4 THEN 0 ELSE sz END, tid) AS sz FROM trades GROUP BY ALL)
             WHERE sz <> 0) WHERE level < 5"""
    ),
    "book_history": _sql(
        """, u AS (SELECT coin, tid, CASE WHEN side = 'A' THEN 'bid' ELSE 'ask' END AS side, px, CASE WHEN sz < 4 THEN 0 ELSE sz END AS sz FROM trades),
           v AS (SELECT *, lead(tid) OVER (PARTITION BY coin, side, px ORDER BY tid) AS until FROM u),
           live AS (SELECT u.coin, u.tid, v.side, v.px, v.sz, row_number() OVER (PARTITION BY u.tid, v.side ORDER BY CASE WHEN v.side = 'bid' THEN -v.px ELSE v.px END) - 1 AS level
                    FROM u JOIN v ON v.coin = u.coin AND v.tid <= u.tid AND (v.until IS NULL OR v.until > u.tid) AND v.sz <> 0)
           SELECT u.coin, u.tid, """
        + ", ".join(f"max({c}) FILTER (l.side = '{s}' AND level = {i}) AS {s}{i}_{c}" for s in ("bid", "ask") for i in range(5) for c in ("px", "sz")).replace("max(px)", "max(l.px)").replace("max(sz)", "max(l.sz)")
        + """, coalesce(max(l.px) FILTER (l.side = 'bid' AND level = 0) >= max(l.px) FILTER (l.side = 'ask' AND level = 0), false) AS crossed
           FROM u LEFT JOIN live l USING (tid) GROUP BY u.coin, u.tid"""
    ),
    "depth_at_price": _sql(
        """SELECT event_id, l.coin, CASE WHEN side = 'A' THEN coalesce(bid_sz[list_position(bid_px, px)], 0) ELSE coalesce(ask_sz[list_position(ask_px, px)], 0) END AS depth
           FROM l2book l JOIN trades t ON t.tid = l.event_id"""
    ),
    "ofi": _sql("SELECT event_id, coin, ofi FROM flow", FLOW),
    "realized_vol": _sql("SELECT event_id, coin, round(log_ret_1, 9) + 0.0 AS log_ret_1, round(realized_vol, 9) AS realized_vol FROM flow", FLOW),
    "momentum": _sql("SELECT event_id, coin, round(momentum, 9) + 0.0 AS momentum FROM flow", FLOW),
    "liquidity_zscore": _sql("SELECT event_id, coin, d AS depth_within_5bps, round(z, 6) + 0.0 AS liquidity_z FROM z", ZSCORE),
    "drought_flag": _sql("SELECT event_id, coin, coalesce(z < -2.0, false) AS liquidity_drought FROM z", ZSCORE),
    "price_sigma": _sql("SELECT event_id, coin, round(sigma, 7) AS sigma FROM sig", SIGMA),
    "gaps": _sql("SELECT * FROM (SELECT event_id, coin, exch_time_ms - lag(exch_time_ms) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS gap_ms FROM l2book) WHERE gap_ms > 1500000"),
    "median_interval": _sql(
        "SELECT coin, coalesce(quantile_cont(CAST(d AS DOUBLE), 0.5), 1.0) AS median_interval_ms FROM (SELECT coin, exch_time_ms - lag(exch_time_ms) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS d FROM l2book) GROUP BY coin"
    ),
    "forward_returns": _sql(
        "SELECT event_id, coin, "
        + ", ".join(f"round(max({c}_ret) FILTER (h = {h}), 9) + 0.0 AS fwd_logret_{p}_{h}ms" for h in HORIZONS for c, p in (("mid", "mid"), ("micro", "microprice")))
        + " FROM fwd GROUP BY event_id, coin",
        FORWARD,
    ),
    "forward_index": _sql(
        """, n AS (SELECT coin, exch_time_ms, row_number() OVER (PARTITION BY coin ORDER BY exch_time_ms) - 1 AS idx, count(*) OVER (PARTITION BY coin) AS total FROM l2book)
           SELECT a.coin, a.exch_time_ms, a.idx, coalesce(b.idx, a.total) AS fwd_idx
           FROM (SELECT *, exch_time_ms + 600000 AS target FROM n) a ASOF LEFT JOIN n b ON a.coin = b.coin AND a.target <= b.exch_time_ms"""
    ),
    "trade_book_match": _sql("SELECT t.tid, t.coin, b.mid, b.event_id FROM trades t ASOF LEFT JOIN sp b ON t.coin = b.coin AND t.exch_time_ms >= b.exch_time_ms"),
    "latest_funding": _sql(
        """, c AS (SELECT coin, arg_max(funding, recv_ts_ns) AS current FROM asset_ctx GROUP BY coin),
           p AS (SELECT coin, arg_max(funding_rate, recv_ts_ns) AS predicted FROM predicted WHERE venue = 'HlPerp' GROUP BY coin)
           SELECT coin, current, predicted, round(pow(1 + current, 8760) - 1, 6) + 0.0 AS current_apr, round(pow(1 + predicted, 8760) - 1, 6) + 0.0 AS predicted_apr FROM c FULL JOIN p USING (coin)"""
    ),
    "funding_by_venue": _sql("SELECT coin, venue, CAST(funding_interval_hours AS BIGINT) AS funding_interval_hours, count(*) AS n, sum(funding_rate) AS rate, max(next_funding_time_ms) AS next_ms FROM predicted GROUP BY ALL"),
    "parse_l2book": _sql(
        "SELECT coin, exch_time_ms, recv_ts_ns, bid_px[20] AS bid_px19, ask_sz[4] AS ask_sz3, 20 AS levels, CAST(list_sum([1 + (event_id + i) % 9 FOR i IN range(0, 20)]) AS BIGINT) AS orders FROM l2book"
    ),
    "parse_trades": _sql("SELECT coin, side, px, sz, exch_time_ms, recv_ts_ns, tid FROM trades"),
    "parse_asset_ctx": _sql("SELECT coin, recv_ts_ns, funding, oracle_px, CAST(NULL AS DOUBLE) AS mid_px FROM asset_ctx"),
    "parse_predicted_funding": _sql("SELECT coin, venue, funding_rate, next_funding_time_ms, CAST(funding_interval_hours AS BIGINT) AS funding_interval_hours, recv_ts_ns FROM predicted"),
    "log_hours": _sql("SELECT strftime(make_timestamp(recv_ts_ns // 1000), '%Y%m%d') AS date, strftime(make_timestamp(recv_ts_ns // 1000), '%H') AS hour, count(*) AS n FROM trades GROUP BY ALL"),
    "symbol_scan": _sql("SELECT tid, coin, side, px, sz FROM trades WHERE coin = 'ETH' AND px >= 9990"),
    "chrono_split": _sql(
        "SELECT event_id, coin, exch_time_ms <= min(exch_time_ms) OVER w + 0.7::DOUBLE * (max(exch_time_ms) OVER w - min(exch_time_ms) OVER w) AS is_train FROM l2book WINDOW w AS (PARTITION BY coin)"
    ),
    "train_threshold": _sql("SELECT coin, feature, round(quantile_cont(abs(x), 0.75), 8) AS threshold FROM long WHERE is_train GROUP BY ALL", CELLS),
    "information_coefficient": _sql(
        f"""SELECT coin, feature, horizon_ms, n, round(pearson, 7) + 0.0 AS pearson, round(spearman, 7) + 0.0 AS spearman,
                   round({_corr_p("pearson")}, 7) + 0.0 AS pearson_p, round({_corr_p("spearman")}, 7) + 0.0 AS spearman_p FROM ic""",
        CELLS,
        IC,
    ),
    "hit_rate": _sql(f"SELECT *, round(hits / hit_n, 8) AS hit_rate, round({HIT_P}, 8) + 0.0 AS hit_rate_p FROM hit", CELLS, HITS),
    "net_of_cost": _sql(
        f"""SELECT coin, feature, horizon_ms, net_n, round(net_mean_bps, 5) AS net_mean_bps, round(net_pct_positive, 5) AS net_pct_positive, round(net_t, 5) AS net_t,
                   round({NET_P}, 5) + 0.0 AS net_p FROM nt""",
        CELLS,
        NET,
    ),
    **{
        name: _sql(
            f"SELECT coin, feature, horizon_ms, n, round(beta, 9) + 0.0 AS beta, round(t, 5) + 0.0 AS t, round({_normal_p('t')}, 7) + 0.0 AS p, round(r2, 8) + 0.0 AS r2 FROM hac",
            CELLS,
            HCELLS,
            _hac("", used),
        )
        for name, used in (("hac_regression", ()), ("hac_regression_controls", CONTROLS))
    },
    "imbalance_study": _sql(
        f"""SELECT ic.coin, ic.feature, ic.horizon_ms, ic.n, round(pearson, 7) + 0.0 AS pearson, round({_corr_p("pearson").replace("(n - 2)", "(ic.n - 2)")}, 7) + 0.0 AS pearson_p,
                   round(spearman, 7) + 0.0 AS spearman, round({_corr_p("spearman").replace("(n - 2)", "(ic.n - 2)")}, 7) + 0.0 AS spearman_p, round(hits / hit_n, 7) AS hit_rate, round({HIT_P}, 7) + 0.0 AS hit_rate_p,
                   round(h.beta, 9) + 0.0 AS ols_beta, round({_normal_p("h.t")}, 7) + 0.0 AS ols_p, round(h.r2, 7) + 0.0 AS ols_r2,
                   round(k.beta, 9) + 0.0 AS ols_beta_ctrl, round({_normal_p("k.t")}, 7) + 0.0 AS ols_p_ctrl, round(k.r2, 7) + 0.0 AS ols_r2_ctrl,
                   round(threshold, 7) AS threshold, round(net_mean_bps, 5) AS net_mean_bps, round(net_pct_positive, 5) AS net_pct_positive, net_n, round({NET_P}, 5) + 0.0 AS net_p
            FROM ic LEFT JOIN hit USING (coin, feature, horizon_ms) LEFT JOIN nt USING (coin, feature, horizon_ms) LEFT JOIN th USING (coin, feature)
                 LEFT JOIN hac h USING (coin, feature, horizon_ms) LEFT JOIN hac_ctrl k USING (coin, feature, horizon_ms)""",
        CELLS,
        IC,
        HITS,
        NET,
        HCELLS,
        _hac("", ()),
        _hac("_ctrl", CONTROLS),
    ),
    "ols_univariate": _sql(
        "SELECT coin, feature, horizon_ms, round(regr_slope(y, x), 7) + 0.0 AS beta, round(regr_r2(y, x), 7) AS r2 FROM cells WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL", CELLS
    ),
    "maxlags": _sql(
        """, i AS (SELECT coin, quantile_cont(CAST(d AS DOUBLE), 0.5) AS m FROM (SELECT coin, exch_time_ms - lag(exch_time_ms) OVER (PARTITION BY coin ORDER BY exch_time_ms) AS d FROM l2book) GROUP BY coin)
           SELECT coin, h AS horizon_ms, CAST(least(500, greatest(1, ceil(h / m))) AS INT) AS lags FROM i, (SELECT unnest([60000, 300000, 600000, 1800000, 3600000]::BIGINT[]) AS h)"""
    ),
    "merged_events": _sql(
        """, e AS (
             SELECT coin, exch_time_ms AS ts_ms, 0 AS kind, recv_ts_ns, 0::BIGINT AS seq FROM l2book
             UNION ALL SELECT coin, exch_time_ms, 1, recv_ts_ns, tid FROM trades
             UNION ALL SELECT coin, recv_ts_ns // 1000000, 2, recv_ts_ns, 0 FROM asset_ctx)
           SELECT *, CAST(row_number() OVER (PARTITION BY coin, ts_ms // 86400000 ORDER BY ts_ms, kind, recv_ts_ns, seq) AS INT) AS nth_of_day FROM e"""
    ),
    "quotes_naive": _sql(
        """, u AS (SELECT *, event_id % 13 - 6 AS inv, event_id % 17 = 0 AS dry, microprice * 0.5 / 10000 AS half FROM top)
           SELECT event_id, coin, CASE WHEN NOT dry THEN round(microprice - half, 7) END AS bid_px, CASE WHEN NOT dry AND inv < 5 THEN 0.5::DOUBLE ELSE 0 END AS bid_sz,
                  CASE WHEN NOT dry THEN round(microprice + half, 7) END AS ask_px, CASE WHEN NOT dry AND inv > -5 THEN 0.5::DOUBLE ELSE 0 END AS ask_sz FROM u"""
    ),
    "quotes_inventory": _sql(
        """, u AS (SELECT *, event_id % 13 - 6 AS inv, event_id % 17 = 0 AS dry, 0.0001::DOUBLE * sigma * sigma * 300 AS risk FROM sig),
           h AS (SELECT *, mid - inv * risk AS centre, greatest(0.5 / 10000 * mid, 0.5 * risk) AS half FROM u)
           SELECT event_id, coin, CASE WHEN NOT dry THEN round(centre - half, 7) END AS bid_px, CASE WHEN NOT dry AND inv < 5 THEN 0.5::DOUBLE ELSE 0 END AS bid_sz,
                  CASE WHEN NOT dry THEN round(centre + half, 7) END AS ask_px, CASE WHEN NOT dry AND inv > -5 THEN 0.5::DOUBLE ELSE 0 END AS ask_sz FROM h""",
        SIGMA,
    ),
    "cash_and_inventory": _sql(
        "SELECT tid, coin, round(100000 - sum(signed * px + fee) OVER w + 2e-7, 6) AS cash, sum(signed) OVER w AS inventory FROM fl WINDOW w AS (PARTITION BY coin ORDER BY exch_time_ms, tid)", SIGNED
    ),
    "funding_accrual": _sql(
        """SELECT coin, seq AS recv_ts_ns, inventory, round(payment, 5) + 0.0 AS payment, round(funding_paid, 5) + 0.0 AS funding_paid, round(held_paid, 5) + 0.0 AS held_paid
           FROM led WHERE kind = 2""",
        SIGNED,
        LEDGER,
    ),
    "marked_equity": _sql(
        """SELECT coin, ts AS ts_ms, inventory, round(funding_paid, 5) + 0.0 AS funding_paid, round(100000 - spent - funding_paid + inventory * mid + 2e-7, 4) + 0.0 AS equity
           FROM led WHERE kind = 0""",
        SIGNED,
        LEDGER,
    ),
    "inventory_volatility": _sql(
        """SELECT tid, coin, round(CASE WHEN count(*) OVER w >= 7 THEN stddev_samp(signed) OVER w END, 7) AS inventory_vol
           FROM fl WINDOW w AS (PARTITION BY coin ORDER BY exch_time_ms ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        SIGNED,
    ),
    "average_cost": BASE.replace("WITH base", "WITH RECURSIVE base", 1)
    + SIGNED
    + """,
        f AS (SELECT coin, exch_time_ms // 86400000 AS day, px, signed, fee, row_number() OVER (PARTITION BY coin ORDER BY exch_time_ms, tid) AS n FROM fl),
        pos(coin, n, inv, avg, got, paid) AS (
          SELECT coin, n, signed, px, 0.0::DOUBLE, fee FROM f WHERE n = 1
          UNION ALL
          SELECT f.coin, f.n, inv + signed,
                 CASE WHEN inv = 0 THEN px WHEN inv * signed > 0 THEN (avg * abs(inv) + px * abs(signed)) / abs(inv + signed)
                      WHEN (inv + signed) * inv < 0 THEN px ELSE avg END,
                 got + CASE WHEN inv * signed < 0 THEN sign(inv) * (px - avg) * least(abs(signed), abs(inv)) ELSE 0 END, paid + fee
          FROM pos JOIN f ON f.coin = pos.coin AND f.n = pos.n + 1)
        SELECT coin, day, inv AS inventory, round(avg, 5) AS avg_price, round(got, 4) + 0.0 AS realized, round(paid, 4) AS fees_paid, round((px - avg) * inv, 4) + 0.0 AS unrealized
        FROM (SELECT *, row_number() OVER (PARTITION BY coin, day ORDER BY n DESC) AS k FROM pos JOIN f USING (coin, n)) WHERE k = 1""",
    "turnover": _sql("SELECT coin, count(*) AS n_fills, round(sum(px * sz), 4) AS turnover_usd, round(sum(fee), 4) AS fees_paid FROM fl GROUP BY coin", SIGNED),
    "drawdown": _sql("SELECT event_id, coin, round((equity - peak) / CASE WHEN peak = 0 THEN 2.220446049250313e-16 ELSE peak END, 8) + 0.0 AS drawdown FROM ch", CURVE),
    "sharpe_var_es": _sql(
        """, s AS (SELECT coin, count(change) AS n, avg(change) AS mean, stddev_pop(change) AS sd, greatest((max(exch_time_ms) - min(exch_time_ms)) / 1000, 1) AS secs,
                          quantile_cont(change, 0.05) AS q, min((equity - peak) / CASE WHEN peak = 0 THEN 2.220446049250313e-16 ELSE peak END) AS dd FROM ch GROUP BY coin),
           t AS (SELECT ch.coin, avg(change) AS tail FROM ch JOIN s USING (coin) WHERE change <= q GROUP BY ch.coin)
           SELECT coin, n, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(n / secs * 31536000) ELSE 0 END, 6) + 0.0 AS sharpe, round(dd, 6) + 0.0 AS max_drawdown,
                  round(-q, 6) + 0.0 AS value_at_risk, round(-tail, 6) + 0.0 AS expected_shortfall FROM s JOIN t USING (coin)""",
        CURVE,
    ),
} | {
    f"depth_imbalance_{s}": _sql("SELECT event_id, coin, " + ", ".join(f"round({_depth(n, s)}, 8) + 0.0 AS imbalance_d{n}" for n in (5, 10, 20)) + " FROM l2book")
    for s in ("linear_decay", "uniform", "exp_decay")
}
