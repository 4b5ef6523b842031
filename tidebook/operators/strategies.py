"""Quoting rules: functions of a book's columns and one's own inventory.

What a rule needs to know of the market (microprice, volatility, droughts, any signal) is a column of the books, made
by Spark before the replay; a rule keeps nothing. Anyone's function of that form is a strategy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from ..config import InventoryAware, Settings, Symmetric

#: (bid price, bid size, ask price, ask size); a null price or a size of 0 is no quote on that side.
Quote = tuple[float | None, float, float | None, float]
Rule = Callable[[Mapping[str, Any], float], Quote]

NONE: Quote = (None, 0.0, None, 0.0)


def around(centre: float, half: float, s: Symmetric | InventoryAware, held: float) -> Quote:
    """Both sides of a centre; the one that would add to an inventory at its cap has no size."""
    long_full, short_full = held >= s.max_inventory, held <= -s.max_inventory
    return centre - half, 0.0 if long_full else s.quote_size, centre + half, 0.0 if short_full else s.quote_size


def symmetric(s: Symmetric) -> Rule:
    """A fixed distance from the microprice; nothing in a drought."""

    def rule(book: Mapping[str, Any], held: float) -> Quote:
        if book["liquidity_drought"]:
            return NONE
        fair = book["microprice"]
        return around(fair, fair * s.half_spread_bps / 10_000, s, held)

    return rule


def inventory_aware(s: InventoryAware) -> Rule:
    """Leans against the inventory and widens with the variance of the mid's recent steps (column sigma); nothing in a drought."""

    def rule(book: Mapping[str, Any], held: float) -> Quote:
        if book["liquidity_drought"]:
            return NONE
        risk = s.risk_aversion * book["sigma"] ** 2 * s.decay_s
        return around(book["mid"] - held * risk, max(0.5 * risk, s.half_spread_bps / 10_000 * book["mid"]), s, held)

    return rule


def build(name: str, settings: Settings | None = None) -> Rule:
    settings = settings or Settings()
    known = {"naive_mm": lambda: symmetric(settings.symmetric), "inventory_mm": lambda: inventory_aware(settings.inventory_aware)}
    if name not in known:
        raise ValueError(f"unknown strategy {name!r}")
    return known[name]()
