"""Toxicity by a factorization machine over hashed terms.

Besides a weight per term it learns a short vector per term; the products of the vectors of terms that
meet in a text tell pairs (an insult with the mention of a group) from either term alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ._common import words
from ._scores import labelled_sample, with_score

BUCKETS = 1 << 24
#: Lengths, in bytes, of the beginnings of words that count as terms.
STEMS = (4, 5, 6)


def hashed(text: bytes) -> set[int]:
    """The buckets of a text's terms: its distinct words, and their first letters, which inflected
    and compound forms share. Whole texts."""
    terms = set(words(text))
    for n in STEMS:
        terms |= {b"^" + w[:n] for w in terms if len(w) > n and w[0] != 94}
    return {zlib.crc32(w) % BUCKETS for w in terms}


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of the vectors' products, as a probability. The pairs' sum is
    divided by the number of chosen terms, so that it grows with the text as the weights' sum does. Buckets that
    were not chosen in training weigh nothing, so long texts gather no noise from their many terms."""

    place: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, text: bytes) -> float:
        at = [p for x in hashed(text) if (p := self.place.get(x)) is not None]
        v = self.vectors[at]
        margin = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum()) / max(1, len(at))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def gaps(with_1: np.ndarray, total: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how many standard errors the shares of texts that have something differ between the labels."""
    share = total / (n1 + n0)
    return np.abs(with_1 / n1 - (total - with_1) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)


def chosen_buckets(sets: list[np.ndarray], y: np.ndarray, most: int, least: int, z: float, pair_z: float) -> np.ndarray:
    """Buckets in at least `least` texts that differ between the labels by z standard errors, the clearest
    first, and then both buckets of pairs that meet in texts of one label by pair_z errors. Pairs are
    looked for among the `most` buckets that vary most: there, a term need not tell anything alone."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket, index, total = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint32), return_inverse=True, return_counts=True)
    gap = gaps(np.bincount(index, weights=y[owner], minlength=len(bucket)), total, n1, n0)
    gap[total < least] = 0
    order = np.lexsort((bucket, -gap))[:most]
    alone = order[gap[order] >= z]
    share = total / len(sets) if sets else total
    varied = np.lexsort((bucket, -share * (1 - share)))[:most]
    varied = varied[total[varied] >= least]
    column = np.full(len(bucket), -1)
    column[varied] = np.arange(len(varied))
    seen = column[index] >= 0
    x = np.zeros((len(sets), len(varied)), np.float32)
    x[owner[seen], column[index[seen]]] = 1
    both, toxic = x.T @ x, x[y > 0].T @ x[y > 0]
    pair = gaps(toxic, both, n1, n0)
    pair[(both < least) | np.tri(len(varied), dtype=bool)] = 0
    a, b = np.nonzero(pair >= pair_z)
    met = varied[np.unique(np.concatenate([a, b]))] if len(a) else varied[:0]
    return bucket[np.concatenate([alone, met[~np.isin(met, alone)]])]


def train(
    sample: list[tuple[bytes, int]], factors: int = 4, most: int = 1024, least: int = 3, z: float = 3.0, pair_z: float = 6.0, steps: int = 1280, batch: int = 256,
    rate: float = 0.03, decay: float = 1e-3, seed: int = 7,
) -> FactorizationMachine:
    """Logistic loss, the rarer label weighted up, with ridge terms, minimised by Adam over mini-batches.
    Without both labels the score is constant."""
    y = np.array([label for _, label in sample], np.float64)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    start = float(np.log(base / (1 - base)))
    sets = [np.fromiter(hashed(t), np.uint32) for t, _ in sample]
    chosen = chosen_buckets(sets, y, most, least, z, pair_z) if 0 < y.sum() < len(y) else np.empty(0, np.uint32)
    place = {x: i for i, x in enumerate(chosen.tolist())}
    weight = np.where(y > 0, np.sqrt((1 - base) / base), 1.0)
    rng = np.random.default_rng(seed)
    n = len(chosen)
    params = [np.array([start]), np.zeros(n), rng.normal(0, 0.01, (n, factors))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rows = [[place[x] for x in s[np.isin(s, chosen)].tolist()] for s in sets]
    size = np.maximum(1.0, np.array([len(r) for r in rows], np.float64))
    while n and step < steps:
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            x = np.zeros((len(part), n))
            for k, r in enumerate(part):
                x[k, rows[r]] = 1.0
            xv = x @ params[2]
            margin = params[0][0] + x @ params[1] + 0.5 * ((xv**2).sum(1) - (x @ params[2] ** 2).sum(1)) / size[part]
            err = weight[part] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            pair = err / size[part]
            of_v = x.T @ (pair[:, None] * xv) - (x.T @ pair)[:, None] * params[2]
            step += 1
            for p, g, m, s in zip(params, (np.array([err.sum()]), x.T @ err + decay * params[1], of_v + decay * params[2]), first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(place, float(params[0][0]), params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000, longest: int = 32 << 10, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Learns from at most `rows` labelled texts of at most `longest` bytes, none of them held out."""
    return train(labelled_sample(docs, labels, label, rows, longest, id_col, text_col))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, every row and all columns or those of `keep`, with the score of its whole text (0 to 1). Null texts score as empty ones; a
    column called like the score is replaced; equal texts score alike; no rows give no rows."""

    def scorer() -> Callable[[bytes], float]:
        return model.score

    return with_score(docs, scorer, text_col, name, keep)
