"""The URL model on words that its training did not have, of either kind."""

from __future__ import annotations

import pytest

from tidebook.llm import urlfilter as u


@pytest.fixture(scope="module")
def model():
    return u.train(u.labelled_urls(words=lambda w: not u.kept_back(w)))


def test_words_are_kept_back_of_both_kinds():
    for words in (u.UNWANTED, u.LOOKALIKES):
        assert 0.1 * len(words) < sum(map(u.kept_back, words)) < 0.35 * len(words)
    seen = " ".join(a for a, _ in u.labelled_urls(words=lambda w: not u.kept_back(w)))
    assert "baccarat" not in seen or not u.kept_back("baccarat")


def test_unseen_roots_and_unseen_lookalikes(model):
    """Urls of held-out roots, mostly with something around them, and of held-out lookalikes, words and invented names."""
    table = u.labelled_urls(4000, seed=77, words=u.kept_back)
    blocked = {y: sum(model.probability(a) >= 0.5 for a, label in table if label == y) / sum(label == y for _, label in table) for y in (0, 1)}
    assert blocked[1] >= 0.4 and blocked[0] <= 0.04 and blocked[1] > 12 * blocked[0]
    alone = [w for w in u.LOOKALIKES if u.kept_back(w)]
    assert sum(model.probability(f"{w}.com/") >= 0.5 for w in alone) <= 0.15 * len(alone)


def test_seen_roots(model):
    table = [(a, y) for a, y in u.labelled_urls(2000, seed=6, words=lambda w: not u.kept_back(w))]
    right = sum((model.probability(a) >= 0.5) == bool(y) for a, y in table)
    assert right >= 0.93 * len(table)
