"""Collocations against a plain count, and the summaries' guarantee."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, threshold, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    by = defaultdict(list)
    for (lang, w), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(len(v) > len(w) and x == lang and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= share * a for (x, v), b in found.items())
        if not inside:
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def corpus(seed, n=300, words=12):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "Été", "été", "THE", "the", "日本", "x\x0by"][:words]
    share = 1 / np.arange(1, words + 1)
    rows = []
    for i in range(n):
        text = "".join(f"{w}{s}" for w, s in zip(rng.choice(vocabulary, 40, p=share / share.sum()), rng.choice([" ", "  ", "\t", ", ", "\n", "\x85"], 40, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]), strict=True))
        rows.append((["en", "de", None][i % 3], text))
    return rows + [("en", "one fixed phrase here " * 40), ("en", None), ("fr", ""), (None, "...")]


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, "z") for i, (a, b) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")


def collected(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("threshold", "top", "capacity"), [(5, 2000, None), (30, 7, 40)])
def test_equals_a_plain_count(spark, threshold, top, capacity):
    rows = corpus(threshold)
    found = collected(phrases.collocations(frame(spark, rows), threshold, top, capacity=capacity))
    assert found == plain(rows, threshold, top) and len(found) > 10


def test_long_texts_and_small_blocks(spark, monkeypatch):
    rows = corpus(1, 20)
    rows += [("en", " ".join(x or "" for _, x in corpus(2, 60))), ("en", "w" * 500 + " " + "a b c d " * 50)]
    want = [list(x) for x in phrases.blocks([])]
    assert want == []
    monkeypatch.setattr(phrases, "BLOCK", 97)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([a or "und" for a, _ in rows]), pa.array([(b or "").encode() for _, b in rows])], ["lang", "text"])
    f = Counter()
    for block in phrases.blocks([batch]):
        words = phrases.Words(*block)
        tokens = block[0].translate(phrases.TO_SPACES).split()
        for m, at, _ in words.grams():
            f.update((words.langs[words.lang[i]], b" ".join(tokens[i : i + m])) for i in at.tolist())
    plainly = Counter()
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            own = re.findall(rb"[^\x20\x09]+", piece)
            for m in range(1, 5):
                plainly.update((lang or "und", b" ".join(own[i : i + m])) for i in range(len(own) - m + 1))
    assert f == plainly


def test_edges(spark):
    empty = frame(spark, [])
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", ""), ("en", "one two")])).count() == 0
    twice = [("en", "Big Deal. " * 20)] * 2  # equal rows count each
    assert collected(phrases.collocations(frame(spark, twice))) == [("en", 1, "big deal", 40, 40, 40, 80, 1_000_000)]
    with pytest.raises(ValueError, match="threshold"):
        phrases.collocations(empty, 200)


def test_exact_products(spark):
    """Scores of counts whose product passes 64 bits."""
    a, part = 9_000_000_000_000_000_001, 9_100_000_000_000_000_003
    row = spark.createDataFrame([(a, part, part)], "a long, l long, r long")
    got = row.selectExpr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS s").first().s
    assert got == 2_000_000 * a // (2 * part)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=12), st.integers(2, 9), st.integers(1, 40))
def test_no_frequent_key_is_lost(parts, threshold, capacity):
    summary, true = phrases.Summary(capacity, threshold), Counter()
    for part in parts:
        true.update(part)
        summary.merge(phrases.packed(np.array(part, np.uint64)))
    found = set(summary.survivors().tolist())
    assert {k for k, v in true.items() if v >= threshold} <= found <= set(true)
    assert summary.off < threshold
    if capacity * threshold > sum(true.values()):  # the method's condition: the summary never outgrows its capacity
        assert len(summary.keys) <= capacity
