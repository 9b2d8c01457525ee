"""Copies of benchmark items in large groups, against brute force."""

import numpy as np
import pytest

from tickloom.llm import decontaminate


@pytest.mark.parametrize("sent", [10**6, 0])
def test_edited_copies_of_large_groups(spark, sent, monkeypatch):
    """The seeds of a much copied item are frequent only because of its copies."""
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    rng = np.random.default_rng(6)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    items, texts = {i: words(40) for i in range(3)}, {}
    for k in range(3000):
        own, item = list(items[k % 3]), k % 3
        for j in range(0, 40, 4):
            own[j] = f"x{rng.integers(10**6)}"
        for j in rng.integers(0, 40, 0 if item == 0 else rng.integers(0, 5)):
            own[j] = "y"
        texts[k] = words(15) + own + words(15)
    texts |= {3000 + k: words(9) + items[1] + words(9) for k in range(5)}
    pairs = [(k, k % 3 if k < 3000 else 1) for k in texts]
    best, _ = decontaminate.align([items[i] for _, i in pairs], [texts[k] for k, _ in pairs])
    # every copy with a seed in it
    seeds = {i: {tuple(x[j : j + 3]) for j in range(38)} for i, x in items.items()}
    want = {(k, i) for (k, i), s in zip(pairs, best.tolist(), strict=True) if s >= 40 and any(tuple(texts[k][j : j + 3]) in seeds[i] for j in range(len(texts[k]) - 2))}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()} == want and 1005 < len(want) < 3005


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "x y alpha beta gamma delta z"), (2, "alpha beta one two"), (3, "of the and")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta"), (8, "of the"), (7, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(docs, items).collect()] == [(1, 9, 1.0)]
