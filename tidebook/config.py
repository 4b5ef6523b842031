"""Settings with their defaults, and a loader for YAML or JSON files."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Capture:
    ws_url: str = ""
    data_dir: str = "data"
    ping_s: float = 20.0
    backoff_base_s: float = 1.0
    backoff_max_s: float = 60.0
    jitter_s: float = 1.0
    gap_s: float = 15.0


@dataclass(frozen=True)
class Analytics:
    depths: tuple[int, ...] = (5, 10, 20)
    depth_bps: float = 10.0
    window_rows: int = 300
    drought_z: float = -2.5


@dataclass(frozen=True)
class Fees:
    maker_bps: float = 1.5
    taker_bps: float = 4.5


@dataclass(frozen=True)
class Symmetric:
    half_spread_bps: float = 1.5
    quote_size: float = 0.01
    max_inventory: float = 0.5


@dataclass(frozen=True)
class InventoryAware:
    risk_aversion: float = 1e-4
    vol_lookback_s: float = 60.0
    decay_s: float = 300.0
    max_inventory: float = 0.5
    quote_size: float = 0.01
    half_spread_bps: float = 1.5


@dataclass(frozen=True)
class Backtest:
    fill_fraction: float = 0.5
    starting_cash: float = 100_000.0


@dataclass(frozen=True)
class Research:
    horizons_ms: tuple[int, ...] = (100, 500, 1000, 5000, 10_000)
    train_fraction: float = 0.7
    lookback_rows: int = 20
    threshold_quantile: float = 0.75


@dataclass(frozen=True)
class Settings:
    symbols: tuple[str, ...] = ("BTC", "ETH", "SOL")
    capture: Capture = field(default_factory=Capture)
    analytics: Analytics = field(default_factory=Analytics)
    fees: Fees = field(default_factory=Fees)
    symmetric: Symmetric = field(default_factory=Symmetric)
    inventory_aware: InventoryAware = field(default_factory=InventoryAware)
    backtest: Backtest = field(default_factory=Backtest)
    research: Research = field(default_factory=Research)


def _merged(kind: Any, given: dict[str, Any]) -> Any:
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := given.keys() - known.keys():
        raise ValueError(f"unknown settings {sorted(unknown)} for {type(kind).__name__}")
    new = {}
    for k, v in given.items():
        old = getattr(kind, k)
        new[k] = _merged(old, v) if dataclasses.is_dataclass(old) else tuple(v) if isinstance(old, tuple) else v
    return dataclasses.replace(kind, **new)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Defaults, then the file, then TIDEBOOK_WS_URL and TIDEBOOK_DATA_DIR."""
    given: dict[str, Any] = {}
    if path is not None:
        text = Path(path).read_text()
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text) or {}
    settings = _merged(Settings(), given)
    env = dict(os.environ) if env is None else env
    over = {k: env[v] for k, v in (("ws_url", "TIDEBOOK_WS_URL"), ("data_dir", "TIDEBOOK_DATA_DIR")) if env.get(v)}
    return dataclasses.replace(settings, capture=dataclasses.replace(settings.capture, **over)) if over else settings
