"""Quality by weak supervision: rules that vote or abstain, weighed by accuracies that no label was needed for.

Each rule looks at a few counts of a text and calls it good, bad or abstains. How often a rule is right about good and
about bad texts is estimated by expectation-maximisation from how the votes of all texts agree, and a text is kept
by the posterior probability that it is good, not by passing every rule. The model depends on the texts only
through how many have each pattern of votes; rules are few, so patterns are, and the estimate reads their counts, taken
over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, text_bytes

SYMBOLS = b"#*$%&|<>"
#: ASCII characters that are neither letters, digits nor spaces.
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
SPACE = b" \t\n\r\x0b\x0c"
WIDTH = 8
#: What a sentence ends with, and quotes and brackets after it.
ENDS = tuple(x.encode() for x in ".!?:;…。！？\"'”’»)")
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_adjacent", "n_lettered", "n_upper", "n_lower", "n_marks",
)
#: More rules would make more patterns of votes (3 to their number) than the driver should hold.
MOST_RULES = 10
GOOD, BAD, ABSTAIN = "+", "-", "0"


@dataclass(frozen=True)
class Rule:
    """Votes by a share of two counts: bad on the one side of `bad`, good on the other of `good`, and abstains in
    between, or where there are fewer than `least` of what the share is of."""

    name: str
    part: str
    whole: str
    good: float
    bad: float
    least: int = 1

    def vote(self) -> Column:
        share = F.col(self.part) / F.col(self.whole)
        below = self.good < self.bad  # a small share is good
        good, bad = (share <= self.good, share >= self.bad) if below else (share >= self.good, share <= self.bad)
        return F.when(F.col(self.whole) < self.least, ABSTAIN).when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN)


@dataclass(frozen=True)
class Between(Rule):
    """As a Rule, but good from `good` to `good_to`, and bad below `bad` and beyond `bad_to`."""

    good_to: float = float("inf")
    bad_to: float = float("inf")

    def vote(self) -> Column:
        share = F.col(self.part) / F.col(self.whole)
        good, bad = (share >= self.good) & (share <= self.good_to), (share < self.bad) | (share > self.bad_to)
        return F.when(F.col(self.whole) < self.least, ABSTAIN).when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN)


RULES: tuple[Rule, ...] = (
    Between("length", "n_words", "one", good=50, bad=20),
    Between("word length", "word_chars", "n_words", good=3, good_to=9, bad=2, bad_to=14),
    Rule("symbols", "n_symbols", "n_words", good=0.02, bad=0.1),
    Rule("repeated lines", "n_dup_lines", "n_lines", good=0.05, bad=0.3, least=3),
    Rule("repeated passages", "n_repeat_words", "n_words", good=0.05, bad=0.2, least=20),
    Rule("repeated words", "n_adjacent", "n_words", good=0.02, bad=0.1, least=10),
    Rule("words with letters", "n_lettered", "n_words", good=0.9, bad=0.7),
    Rule("capitals", "n_upper", "n_letters", good=0.2, bad=0.5, least=20),
    Rule("marks", "n_marks", "word_chars", good=0.08, bad=0.12, least=50),
    Rule("sentence ends", "n_ended", "n_lines", good=0.6, bad=0.1, least=3),
)


def repeated(ids: np.ndarray, width: int = WIDTH) -> int:
    """How many of the words stand in a window of `width` words that comes twice or more. Windows are numbered exactly, by
    doubling: one of 2n words is a pair of numbers of windows of n words."""
    if len(ids) < width:
        return 0
    numbers, many, size = ids, None, 1
    while size < width:
        step = min(size, width - size)
        pairs = numbers[: len(numbers) - step] * (int(numbers.max()) + 1) + numbers[step:]
        _, numbers, many = np.unique(pairs, return_inverse=True, return_counts=True)
        size += step
        if len(many) == len(numbers):
            return 0
    if many is None:
        many = np.bincount(numbers)
    twice = many[numbers] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:-width] += twice[: len(ids) - width + 1]
    edge[width:] -= twice[: len(ids) - width + 1]
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The COUNTS of a whole text. Words are what stands between ASCII spaces; lines those that have a word; letters, for
    capitals, those of ASCII; a word with a letter has one of ASCII or a character beyond it."""
    words = raw.split()
    slim = raw.translate(None, SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lettered = np.array([w.upper() != w.lower() or not w.isascii() for w in known], bool)
    marks = len(slim) - len(slim.translate(None, MARKS))
    upper = len(slim) - len(slim.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(slim) - len(slim.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        len(slim.decode("utf-8", "replace")),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(ids),
        len(lines),
        sum(x.rstrip().endswith(ENDS) for x in lines),
        int((ids[1:] == ids[:-1]).sum()),
        int(lettered[ids].sum()) if words else 0,
        upper,
        lower,
        marks,
    )


def counted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id and the COUNTS of the whole text; null counts as empty."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(raw or b"") for raw in text_bytes(batch, "text")]
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(count, schema)


@dataclass
class LabelModel:
    """The share of good texts, and per rule how often its votes are right about good and about bad ones."""

    prior: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good per row of votes (1 good, -1 bad, 0 abstained), taken as independent given the text's kind."""
        log_good = np.log(self.prior) + np.where(votes > 0, np.log(self.right_good), np.where(votes < 0, np.log(1 - self.right_good), 0.0)).sum(axis=1)
        log_bad = np.log(1 - self.prior) + np.where(votes < 0, np.log(self.right_bad), np.where(votes > 0, np.log(1 - self.right_bad), 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))


def estimate(votes: np.ndarray, many: np.ndarray, start: tuple[float, float, float] = (0.8, 0.99, 0.2), strength: float = 0.05, steps: int = 200) -> LabelModel:
    """Expectation-maximisation over patterns of votes (rows) and how many texts have each.

    It starts from `start`: the share of good texts, and how often a vote is right about good and about bad ones: most bad texts
    are bad in one or two respects, so most rules call them good. The start weighs as `strength` times all texts would, so that no
    estimate is 0 or 1, and the result does not depend on the number of texts. A rule whose bad votes come to be as
    frequent among good texts as among bad ones is held uninformative, never turned round.
    """
    rules = votes.shape[1]
    model = LabelModel(start[0], np.full(rules, start[1]), np.full(rules, start[2]))
    total = float(many.sum())
    for _ in range(steps if total else 0):
        good = model.posterior(votes) * many
        bad = many - good
        ask = strength * total
        voted = votes != 0
        prior = (good.sum() + ask * start[0]) / (total + ask)
        right_good = ((good[:, None] * (votes > 0)).sum(axis=0) + ask * start[0] * start[1]) / ((good[:, None] * voted).sum(axis=0) + ask * start[0])
        right_bad = ((bad[:, None] * (votes < 0)).sum(axis=0) + ask * (1 - start[0]) * start[2]) / ((bad[:, None] * voted).sum(axis=0) + ask * (1 - start[0]))
        right_bad = np.maximum(right_bad, 1 - right_good)
        moved = max(abs(prior - model.prior), np.abs(right_good - model.right_good).max(), np.abs(right_bad - model.right_bad).max())
        model = LabelModel(prior, right_good, right_bad)
        if moved < 1e-10:
            break
    return model


def votes_of(patterns: Sequence[str]) -> np.ndarray:
    value = {GOOD: 1, BAD: -1, ABSTAIN: 0}
    return np.array([[value[c] for c in p] for p in patterns], np.int8).reshape(len(patterns), -1)


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, the COUNTS, votes, posterior, base_failed, kept).

    votes has a character per rule, + for good, - for bad, 0 for none; posterior is the probability that the text is good under
    the model estimated from the votes of all rows. base_failed: fewer than 20 words, or over 30 % of
    them in repeated windows of eight. kept: not base_failed, and a posterior of `at_least` or more.

    Null and empty texts have no words: every rule abstains but that of length, and base_failed is true. Repeated rows are
    judged alike, and count as often as they come. No rows give no rows. Other columns are not read.
    """
    if not 1 <= len(rules) <= MOST_RULES:
        raise ValueError(f"1 to {MOST_RULES} rules")
    rows = counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.withColumn("one", F.lit(1)).withColumn("n_letters", F.col("n_upper") + F.col("n_lower"))
    rows = stored(rows.withColumn("votes", F.concat(*[r.vote() for r in rules])).drop("one", "n_letters"), "votes", narrow=False)
    patterns = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("many")).collect()  # at most 3 to the number of rules
    names, many = [r["votes"] for r in patterns], np.array([r["many"] for r in patterns], np.float64)
    votes = votes_of(names) if names else np.zeros((0, len(rules)), np.int8)
    posterior = estimate(votes, many).posterior(votes)
    table = docs.sparkSession.createDataFrame([(n, float(p)) for n, p in zip(names, posterior, strict=True)], "votes string, posterior double")
    rows = rows.join(F.broadcast(table), "votes", "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("posterior") >= at_least)
    return rows.select("doc_id", *COUNTS, "votes", "posterior", failed.alias("base_failed"), kept.alias("kept"))
