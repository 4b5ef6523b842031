"""Quality by compression: texts like the good ones shrink more with a dictionary made of good texts
than with one made of bad texts. The normalised difference of the two sizes is calibrated to a score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from ._scores import labelled_sample, with_score


PIECE = 1024


@dataclass
class CompressionClassifier:
    """Two zstandard dictionaries and the calibration of the size difference."""

    good: bytes
    bad: bytes
    level: int
    weights: np.ndarray
    empty: float

    def features(self) -> Callable[[bytes], list[float]]:
        """Of a text: (size with the bad dictionary - with the good one) / length, above 0 for good
        texts; a term that fades with the length, as short texts tell little; and 1. The whole text is
        compressed, in pieces, each with the dictionary alone before it, so that a long text does not
        become its own dictionary."""
        good, bad = (_compressor(d, self.level) for d in (self.good, self.bad))

        def of(text: bytes) -> list[float]:
            more = 0
            for i in range(0, len(text), PIECE):
                piece = text[i : i + PIECE]
                more += len(bad.compress(piece)) - len(good.compress(piece))
            return [more / (len(text) + 64), 64 / (len(text) + 64), 1.0]

        return of

    def scorer(self) -> Callable[[bytes], float]:
        of = self.features()
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, of(text)), -30, 30)))) if text else self.empty


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(level=level, **options)
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=made, **options)


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary made of the texts; the texts themselves where they are too few for one."""
    parts = [t[i : i + 512] for t in texts for i in range(0, len(t), 512)]
    try:
        return zstandard.train_dictionary(size, parts, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"\n".join(texts)


def calibrated(a: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression (Newton steps, light ridge)."""
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)
    a, w, ridge = a / scale, np.zeros(a.shape[1]), np.full(a.shape[1], 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w -= np.linalg.solve(hess, a.T @ (p - y) + ridge * w)
    return w / scale


def train(sample: list[tuple[bytes, int]], size: int = 256 << 10, level: int = 3) -> CompressionClassifier:
    """Dictionaries from two thirds of the sample, calibration on the other third. Without both labels
    the score is the share of good texts. Empty texts have no size to compare: they score the share of good
    ones among labelled empty texts, with one bad one more, so that nothing is held good for lack of text."""
    base = float(np.clip(np.mean([y for _, y in sample]) if sample else 0.5, 1e-3, 1 - 1e-3))
    blank = [y for t, y in sample if not t]
    empty = sum(blank) / (len(blank) + 1)
    fitted, rest = [x for i, x in enumerate(sample) if i % 3], [x for x in sample[::3] if x[0]]
    good, bad = ([t for t, y in fitted if y == k and t] for k in (1, 0))
    model = CompressionClassifier(dictionary(good, size), dictionary(bad, size), level, np.array([0.0, 0.0, np.log(base / (1 - base))]), empty)
    if good and bad and 0 < sum(y for _, y in rest) < len(rest):
        of = model.features()
        model.weights = calibrated(np.array([of(t) for t, _ in rest]), np.array([float(y) for _, y in rest]))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000, longest: int = 32 << 10, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> CompressionClassifier:
    """Learns from at most `rows` labelled texts of at most `longest` bytes, none of them held out."""
    return train(labelled_sample(docs, labels, label, rows, longest, id_col, text_col))


def score_quality(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, every row and all columns or those of `keep`, with the score of its whole text (0 to 1). Null and empty texts score as
    labelled empty ones do, 0 without any; a column called like the score is replaced; equal texts score alike; no
    rows give no rows."""
    return with_score(docs, model.scorer, text_col, name, keep)
