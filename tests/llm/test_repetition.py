"""Repetition measures against plain loops."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import queries, repetition

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": 0, "dup_line_chars": 0}
    seen = set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)
    for n in (3, *repetition.GRAM_LIMITS):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)}
        if n == 3:
            out["n_repeat_words"] = len(covered)
        else:
            out[f"dup_{n}_chars"] = sum(len(words[i]) for i in covered)
    return [out[f] for f in repetition.FIELDS]


TEXTS = st.lists(st.sampled_from(["a", "b", "été", "日本 ", "\n", "\n\n", " ", "\x0b", "\x85x", "#$", "a b a b a b a\n", "c d e f g h i j k l m "]), max_size=60).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_measures_equal_plain_loops(texts):
    assert repetition.measures(texts).tolist() == [plain(t) for t in texts]


def test_one_hash_for_all(monkeypatch):
    """Windows of one hash are told apart by their words."""
    monkeypatch.setattr(repetition, "mixed", np.zeros_like)
    texts = ["a b c d e f g a b c d e f h", "x y z x y w", ""]
    assert repetition.measures(texts).tolist() == [plain(t) for t in texts]


def test_whole_table_keeps_clean_documents(spark):
    rows = {r.doc_id: r for r in queries.op12_repetition(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all([r[f] for f in repetition.FIELDS] == plain(texts[i]) for i, r in rows.items()) and len(rows) == len(texts)
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    clean = [rows[i] for i in good if not rows[i].base_failed]
    assert len(clean) > 100 and np.mean([r.kept for r in clean]) > 0.98
    assert not any(r.kept for r in rows.values() if r.base_failed)


def test_edges(spark):
    line = "a line of more than a few words that comes again and again in this text,"
    rows = [("x", 1, None), ("y", 2, ""), ("z", None, "w " * 60), ("z", 4, "\n".join(f"word{i} and other{i * i}" for i in range(60))), ("q", 4, "\n".join([line] * 9)), ("q", 5, " ".join(f"w{i}" for i in range(200_000)))]
    docs = spark.createDataFrame([*rows, rows[3]], "n_words string, doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.kept) for r in repetition.quality(docs).collect()), key=str)
    assert got == sorted([(1, 0, False), (2, 0, False), (None, 60, False), (4, 180, True), (4, 180, True), (4, 144, False), (5, 200_000, True)], key=str)
    assert repetition.quality(docs.limit(0)).count() == 0
    left = repetition.kept(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, len(r.text)) for r in left.collect()) == sorted((i, len(t)) for _, i, t in [rows[3], rows[3], rows[5]])
