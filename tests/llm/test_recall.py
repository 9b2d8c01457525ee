"""Recall of the passages' signatures at the least length."""

import numpy as np

from tickloom.llm import passages


def recall(pairs: int, around: int) -> float:
    """Share of the pairs of 46 shingles, five of which were changed by one word, that share a signature; `around` more words before and after."""
    rng = np.random.default_rng(21)
    found = 0
    for _ in range(pairs):
        part = rng.integers(0, 10**9, 50)
        other = part.copy()
        other[rng.integers(5, 45)] = -1
        texts = [" ".join(f"v{x}" for x in [*rng.integers(0, 10**9, around), *p, *rng.integers(0, 10**9, around)]) for p in (part, other)]
        d, sig, *_ = passages.joint_windows(*passages.shingle_hashes(texts), 46)
        found += bool(set(sig[d == 0].tolist()) & set(sig[d == 1].tolist()))
    return found / pairs


def test_passages_of_the_least_length_share_a_signature():
    assert recall(1000, 0) >= 0.99
    assert recall(1000, 30) >= 0.99


def test_unlike_texts_of_one_id_and_of_none(spark):
    """No link is lost where texts share an id."""
    words = lambda k, n=80: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = words(1), words(2), words(3)
    rows = [(5, a), (5, b), (6, a + " and a tail of its own"), (7, b), (7, b), (None, c), (None, c + " more"), (9, c), (10, None), (11, words(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(docs).collect()}
    assert got == {(6, 5), (7, 5), (None, None), (9, None)}
    assert passages.repeated_passages(docs.limit(0)).count() == 0
