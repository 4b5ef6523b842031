"""Sums over consecutive scores of least-squares fits, for their Newey-West errors, all cells of a row at once.

Rows are sorted into stretches, ranges of (key, time) that are a task each, and read there in Arrow batches; a cell (a signal and
a horizon) needs its last lags + 1 running sums at hand, no more. Sums that reach into the stretch before are left
open: of those, the running sums at both ends of each stretch are what remains to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import stored

EDGES = "coin string, feature string, horizon_ms long, _stretch int, _i long, _c array<double>, _head boolean, _tail boolean, _products array<double>"


@dataclass(frozen=True)
class Cell:
    """A fit: its names, the columns of its x and y, and what it has found."""

    names: tuple[str, str, int]
    x: str
    y: str
    lags: int
    beta: tuple[float, ...]


class Windows:
    """Products of the sums over each lags + 1 consecutive scores, as they come."""

    def __init__(self, lags: int, k: int):
        self.lags, self.n, self.products = lags, 0, np.zeros((k, k))
        #: running sums up to each of the last lags + 1 rows, at first that before any row
        self.recent = np.zeros((1, k))
        self.heads: list[tuple[int, list[float]]] = []

    def add(self, scores: np.ndarray) -> None:
        sums = np.concatenate([self.recent, self.recent[-1] + np.cumsum(scores, axis=0)])
        first, span = self.n + 1 - len(self.recent), self.lags + 1
        whole = max(self.n + 1, span) - first
        if whole < len(sums):
            m = sums[whole:] - sums[whole - span : len(sums) - span]
            self.products += m.T @ m
        for i in range(self.n + 1, min(self.n + len(scores), self.lags) + 1):
            self.heads.append((i, sums[i - first].tolist()))
        self.n, self.recent = self.n + len(scores), sums[-span:].copy()

    def edges(self) -> Iterator[tuple]:
        """(row, running sums, head, tail, products): the rows whose sum is open, those that may be needed to close one, and the total."""
        if self.n:
            for i, c in self.heads:
                yield i, c, True, False, None
            for i, c in zip(range(self.n, 0, -1), self.recent[::-1].tolist()):
                yield i, c, False, True, None
            yield self.n, self.recent[-1].tolist(), False, False, self.products[np.triu_indices(len(self.products))].tolist()


def _edges(rows: DataFrame, key: list[str], order: list[str], cells: Mapping[tuple, list[Cell]], controls: list[str]) -> DataFrame:
    needed = sorted({c for of in cells.values() for x in of for c in (x.x, x.y)} | set(controls))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, now, windows = TaskContext.get().partitionId(), None, []
        types = pa.schema([("coin", pa.string()), ("feature", pa.string()), ("horizon_ms", pa.int64()), ("_stretch", pa.int32()), ("_i", pa.int64()),
                           ("_c", pa.list_(pa.float64())), ("_head", pa.bool_()), ("_tail", pa.bool_()), ("_products", pa.list_(pa.float64()))])

        def closed() -> Iterator[pa.RecordBatch]:
            for cell, w in windows:
                out = [(*cell.names, stretch, *e) for e in w.edges()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in key]
            turns = np.zeros(batch.num_rows - 1, bool)
            for c in keys:
                turns |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
            values = {c: pc.fill_null(batch.column(c), float("nan")).to_numpy(zero_copy_only=False) for c in needed}
            for a, b in zip(ends, ends[1:]):
                which = tuple(c[a].as_py() for c in keys)
                if which != now:
                    yield from closed()
                    now, windows = which, [(c, Windows(c.lags, len(c.beta))) for c in cells.get(which, ())]
                given = {c: v[a:b] for c, v in values.items()}
                for cell, w in windows:
                    design = np.column_stack([np.ones(b - a), given[cell.x], *[given[c] for c in controls]])
                    y = given[cell.y]
                    kept = ~(np.isnan(design).any(axis=1) | np.isnan(y))
                    design = design[kept]
                    w.add(design * (y[kept] - design @ np.array(cell.beta))[:, None])
        yield from closed()

    slim = rows.where(F.col(key[0]).isNotNull()).select(*dict.fromkeys([*key, *order]), *[F.col(c).cast("double").alias(c) for c in needed])
    return slim.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).mapInArrow(told, EDGES)


def window_products(rows: DataFrame, key: list[str], order: list[str], cells: Mapping[tuple, list[Cell]], controls: list[str], fits: DataFrame) -> DataFrame:
    """(coin, feature, horizon_ms, _products): per cell the sums of the products of any two coefficients' (upper triangle, by rows) sums over
    lags + 1 consecutive scores of the cell's series, padded with as many zeros at both ends.

    `cells` are those of each key, `rows` have the key, the columns of `order`, of the cells and `controls`; a cell leaves out
    rows in which one of its values is missing. `fits` tells the n and lags of the cells.
    """
    cell = ["coin", "feature", "horizon_ms"]
    k = next((len(c.beta) for of in cells.values() for c in of), 1)
    edges = stored(_edges(rows, key, order, cells, controls), "edges")
    totals = edges.where(F.col("_products").isNotNull())
    before = Window.partitionBy(*cell).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, zero: F.coalesce(F.sum(c).over(before), F.lit(zero))
    starts = totals.select(*cell, "_stretch", sums("_i", 0).alias("_rows"), *[sums(F.get("_c", F.lit(i)), 0.0).alias(f"_o{i}") for i in range(k)])
    placed = edges.where(F.col("_products").isNull()).join(starts, [*cell, "_stretch"]).join(F.broadcast(fits.select(*cell, F.col("n").alias("_n"), F.col("lags").alias("_lags"))), cell)
    placed = placed.select(*cell, "_head", "_tail", "_n", "_lags", (F.col("_i") + F.col("_rows")).alias("_i"), *[(F.get("_c", F.lit(i)) + F.col(f"_o{i}")).alias(f"c{i}") for i in range(k)])
    lagged = placed.where("_tail").select(*cell, (F.col("_i") + F.col("_lags") + 1).alias("_i"), *[F.col(f"c{i}").alias(f"l{i}") for i in range(k)])
    heads = placed.where("_head").join(lagged, [*cell, "_i"], "left")
    products = lambda m: F.array(*[m[i] * m[j] for i in range(k) for j in range(i, k)]).alias("_products")
    joined = heads.select(*cell, products([F.col(f"c{i}") - F.coalesce(f"l{i}", F.lit(0.0)) for i in range(k)]))
    # the scores of a least-squares fit sum to 0, so a sum that runs past the end is minus what came before it
    past = placed.where(F.col("_tail") & (F.col("_i") >= F.col("_n") - F.col("_lags")) & (F.col("_i") < F.col("_n"))).select(*cell, products([F.col(f"c{i}") for i in range(k)]))
    every = totals.select(*cell, "_products").unionByName(joined).unionByName(past)
    added: list[Column] = [F.sum(F.get("_products", F.lit(i))) for i in range(k * (k + 1) // 2)]
    return every.groupBy(*cell).agg(F.array(*added).alias("_products"))
