"""The walks of decontamination: the recall they are chosen for, what they reject, and matches against all stretches."""

from __future__ import annotations

import random

import numpy as np

from doppel.llm import decontamination as d


def agree(a, b, walks):
    size = np.full(len(a), a.shape[1])
    return np.any([d.embed(a, size, r) == d.embed(b, size, r) for r in range(walks)], axis=0)


def test_walks_reject_unrelated_windows():
    walks = d.repeats_of(0.8)
    assert 8 <= walks < d.MOST_REPEATS
    rng = np.random.default_rng(3)
    for size in (10, 50, 120):
        a = rng.zipf(1.4, (300, size)) % 5000 + 1  # few words are frequent, as in texts
        b = rng.zipf(1.4, (300, size)) % 5000 + 1
        distinct = rng.integers(1, 2 ** 40, (2, 300, size)).astype(np.uint64)
        assert agree(*distinct, walks).mean() == 0
        assert agree(a.astype(np.uint64), a.astype(np.uint64), 1).all()
        assert agree(a.astype(np.uint64), b.astype(np.uint64), 1).mean() < 0.3


def test_walks_reach_their_recall():
    """On other edits than those the number was found on."""
    walks, rng = d.repeats_of(0.8), np.random.default_rng(4)
    for size in (10, 25, 60, 100):
        items = rng.integers(1, 2 ** 63, (300, size))
        others = [(d.edited(x, size // 5, rng) + [0] * size)[:size] for x in items.tolist()]
        assert agree(items.astype(np.uint64), np.array(others, np.uint64), walks).mean() >= 0.98


def test_matches_are_those_of_all_stretches():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 15, 40])))) for k in range(12)]
    texts = []
    for k in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 80))
        item = items[k % 12][1].split()
        for _ in range(rng.randint(0, len(item) // 4)):
            at = rng.randrange(len(item))
            item[at:at + 1] = rng.choice([[], ["new"], [item[at], "more"]]) if len(item) > 1 else item
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + item + own[at:]))
    number = {w: n for n, w in enumerate({w for t in [*texts, *[t for _, t in items]] for w in t.split()})}
    expected = {}
    for t, text in enumerate(texts):
        for k, item in items:
            words = [number[w] for w in item.split()]
            best = d.best_match(words, [number[w] for w in text.split()], int(0.2 * len(words) + 1e-9))
            if best:
                expected[t, k] = best[0]
    found = {(t, h["item_id"]): h["distance"] for t, hits in enumerate(d.Index(items, 0.8).matches(texts)) for h in hits}
    assert found.items() <= expected.items() and len(expected) > 30
    assert len(found) >= 0.97 * len(expected)
