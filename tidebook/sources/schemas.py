"""Fixed schemas of the stored tables."""

from __future__ import annotations

L2BOOK = (
    "coin string, exch_time_ms long, recv_ts_ns long, bid_px array<double>, bid_sz array<double>, bid_n array<long>, "
    "ask_px array<double>, ask_sz array<double>, ask_n array<long>"
)
TRADES = "coin string, side string, px double, sz double, exch_time_ms long, recv_ts_ns long, tid long, trade_hash string"
ASSET_CTX = (
    "coin string, recv_ts_ns long, funding double, open_interest double, prev_day_px double, day_ntl_vlm double, "
    "premium double, oracle_px double, mark_px double, mid_px double, day_base_vlm double"
)
PREDICTED_FUNDING = "coin string, venue string, funding_rate double, next_funding_time_ms long, funding_interval_hours long, recv_ts_ns long"
TABLES = {"l2book": L2BOOK, "trades": TRADES, "asset_ctx": ASSET_CTX, "predicted_funding": PREDICTED_FUNDING}

#: Numbers of a context message, as sent and as stored: fixed names.
CONTEXT_NUMBERS = {
    "funding": "funding", "openInterest": "open_interest", "prevDayPx": "prev_day_px", "dayNtlVlm": "day_ntl_vlm", "premium": "premium",
    "oraclePx": "oracle_px", "markPx": "mark_px", "midPx": "mid_px", "dayBaseVlm": "day_base_vlm",
}
