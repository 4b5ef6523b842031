"""Top of book, imbalance and ladder expressions. Ladders are arrays, best level first, and may be ragged."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMES = ("linear_decay", "uniform", "exp_decay")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ln(x: Column | str) -> Column:
    """The natural logarithm as the C library gives it, null where x is not above 0. Spark's own differs from it in the last bit for
    some prices, which tells in the ninth decimal of a few among millions of returns."""

    @F.arrow_udf(T.DoubleType())
    def log(x: pa.Array) -> pa.Array:
        return pc.ln(x)

    return F.when(col(x) > 0, log(col(x)))


def top(ladder: Column | str) -> Column:
    """First level, null for an empty ladder."""
    return F.get(col(ladder), F.lit(0))


def ratio(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """a / b, or `otherwise` (null) where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def mid(best_bid: Column | str, best_ask: Column | str) -> Column:
    return (col(best_bid) + col(best_ask)) / 2


def microprice(best_bid: Column | str, bid_size: Column, best_ask: Column | str, ask_size: Column) -> Column:
    """Prices weighed by the other side's size; the mid where both sizes are 0."""
    bid, ask = col(best_bid), col(best_ask)
    return ratio(bid * ask_size + ask * bid_size, bid_size + ask_size, mid(bid, ask))


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 where both are 0. The two are computed once."""
    both = F.array(F.struct(bid.alias("b"), ask.alias("a")))
    return F.get(F.transform(both, lambda x: ratio(x["b"] - x["a"], x["b"] + x["a"], F.lit(0.0))), F.lit(0))


def level_weight(i: Column, n: int | Column, scheme: str) -> Column:
    """Weight of level i, from 0, of n levels: n..1, all 1, or halved from level to level."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown weighting {scheme!r}, one of {SCHEMES}")
    n = F.lit(n) if isinstance(n, int) else n
    return {"linear_decay": (n - i).cast("double"), "uniform": F.lit(1.0), "exp_decay": F.pow(F.lit(0.5), i)}[scheme]


def level_weights(n: int | Column, scheme: str = "linear_decay") -> Column:
    """The weights of n levels as an array."""
    count = F.lit(n) if isinstance(n, int) else n
    levels = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    level_weight(F.lit(0), n, scheme)  # an unknown scheme is refused here
    return F.transform(levels, lambda i: level_weight(i, n, scheme))


def weighted(sizes: Column | str, n: int, scheme: str) -> Column:
    """Sum of the first n sizes weighed by their level of n: one fold over the levels there are. Linear decay is the
    sum of the running sums, and what it still adds for levels that are missing."""
    first = F.slice(col(sizes), 1, n)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    if scheme == "uniform":
        return F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    if scheme == "exp_decay":
        halved = F.struct(F.lit(1.0).alias("run"), F.lit(0.0).alias("total"))
        return F.aggregate(first, halved, lambda a, x: F.struct((a["run"] / 2).alias("run"), (a["total"] + a["run"] * x).alias("total")), lambda a: a["total"])
    if scheme != "linear_decay":
        raise ValueError(f"unknown weighting {scheme!r}, one of {SCHEMES}")
    step = lambda a, x: F.struct((a["run"] + x).alias("run"), (a["total"] + a["run"] + x).alias("total"))
    missing = F.greatest(F.lit(0), n - F.size(col(sizes)))
    return F.aggregate(first, zero, step, lambda a: a["total"] + a["run"] * missing)


def depth_imbalance(bid_sizes: Column | str, ask_sizes: Column | str, n: int, scheme: str = "linear_decay", short_book: str = "truncate") -> Column:
    """Imbalance of the weighted sizes of the first n levels. A book with fewer is weighed as one of its
    own width (`truncate`), or as if the missing levels held nothing (`pad`)."""
    if short_book not in ("pad", "truncate"):
        raise ValueError(f"unknown short_book {short_book!r}")
    bid, ask = weighted(bid_sizes, n, scheme), weighted(ask_sizes, n, scheme)
    if short_book == "truncate" and scheme == "linear_decay":
        # weights of a narrower book are smaller by what its width lacks, on every level
        lacks = F.greatest(F.lit(0), n - F.greatest(F.size(col(bid_sizes)), F.size(col(ask_sizes))))
        held = lambda c: F.aggregate(F.slice(col(c), 1, n), F.lit(0.0), lambda a, x: a + x)
        bid, ask = (F.when(lacks > 0, x - lacks * held(c)).otherwise(x) for x, c in ((bid, bid_sizes), (ask, ask_sizes)))
    return imbalance(bid, ask)


def with_spread(df: DataFrame) -> DataFrame:
    """best_bid, best_ask, mid, spread_abs, spread_bps; null for an empty side, bps null for a mid of 0."""
    df = df.withColumns({"best_bid": top("bid_px"), "best_ask": top("ask_px")})
    df = df.withColumns({"mid": mid("best_bid", "best_ask"), "spread_abs": F.col("best_ask") - F.col("best_bid")})
    return df.withColumn("spread_bps", ratio(F.col("spread_abs"), F.col("mid")) * 10_000)


def with_microprice(df: DataFrame) -> DataFrame:
    """microprice and its deviation from the mid in bps."""
    df = df.withColumn("microprice", microprice("best_bid", top("bid_sz"), "best_ask", top("ask_sz")))
    return df.withColumn("microprice_dev_bps", ratio(F.col("microprice") - F.col("mid"), F.col("mid")) * 10_000)


def with_imbalance(df: DataFrame, depths: tuple[int, ...] = (5, 10, 20), scheme: str = "linear_decay", short_book: str = "truncate") -> DataFrame:
    """tob_imbalance and imbalance_d{N} for every depth."""
    new = {"tob_imbalance": imbalance(top("bid_sz"), top("ask_sz"))}
    return df.withColumns(new | {f"imbalance_d{n}": depth_imbalance("bid_sz", "ask_sz", n, scheme, short_book) for n in depths})


def is_crossed(best_bid: Column | str, best_ask: Column | str) -> Column:
    """Bid at or above ask; false where a side is empty."""
    return F.coalesce(col(best_bid) >= col(best_ask), F.lit(False))


def levels(price: Column | str, size: Column | str, n: int, side: str) -> Column:
    """The n best levels of unsorted arrays, as structs (px, sz), best first."""
    sign = -1 if side == "bid" else 1
    keyed = F.zip_with(col(price), col(size), lambda p, s: F.struct((p * sign).alias("k"), p.alias("px"), s.alias("sz")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: F.struct(x["px"].alias("px"), x["sz"].alias("sz")))


def depth_at(price: Column, ladder_px: Column | str, ladder_sz: Column | str) -> Column:
    """Size shown at exactly this price, 0 where it is not in the ladder."""
    at = F.array_position(col(ladder_px), price)
    return F.when(at > 0, F.get(col(ladder_sz), (at - 1).cast("int"))).otherwise(F.lit(0.0))
