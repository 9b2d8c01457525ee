"""SimHash, repeated lines, repeated passages and benchmark copies against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, line_dedup, passages, queries, shared, simhash

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "extra string, doc_id long, text string, id long, fp int"


def least_reachable(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            for n in (a, b):
                if root[n] > low:
                    root[n], changed = low, True
    return root


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x85\xa0\u2003\x1cab"), st.characters(codec="utf-8")), max_size=40))
def test_hashed_words_are_those_of_split(text):
    h, start, data = shared.hashed_words(shared.plain_bytes(text))
    words = text.lower().split()
    assert len(h) == len(words)
    seen = dict(zip(words, h.tolist(), strict=True))
    assert [seen[w] for w in words] == h.tolist() and len(set(seen.values())) == len(seen)


def test_scratch_tables_go(spark):
    import os

    with shared.scratch(spark):
        rows = shared.stored(spark.range(5), "five")
        where = shared._scratch[-1]
        assert rows.count() == 5 and os.path.isdir(where)
    assert not os.path.exists(where)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    out = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert out == least_reachable(nodes, [e for e in edges if e[0] != e[1]])


def simple_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, texts):
    prints = {k: simple_fingerprint(t or "") for k, t in texts}
    keys = sorted(prints)
    v = np.array([prints[k] for k in keys], np.uint64)
    near = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2)
    root = least_reachable(keys, [(keys[a], keys[b]) for a, b in near if a < b])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(k, f"{prints[k]:016x}", root[k]) for k in keys}


def test_op6_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_simhash(queries.op6_simhash(spark, SF).collect(), texts)


@pytest.mark.parametrize("tile", [3, 40])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(4)] + [np.array([0, 3, 2**64 - 1, 2**64 - 2], np.uint64)]))
    linked = simhash.links(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long"), 2, tile).collect()
    signed = values.view(np.int64).tolist()
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    assert least_reachable(signed, [(r.a, r.b) for r in linked]) == least_reachable(signed, [(signed[a], signed[b]) for a, b in near])


def test_forest_of_many_links():
    x = np.array([sum(1 << b for b in c) for c in ((), (0,), (1,), (0, 1), (2,), (40, 41, 42, 43), (40, 41, 42))] * 3, np.uint64)
    p, q = simhash.forest(x, x, 2)
    assert len(p) <= len(x)
    root = least_reachable(set(x.tolist()), list(zip(p.tolist(), q.tolist(), strict=True)))
    assert len(set(root.values())) == 2


def test_simhash_edges(spark):
    rows = [("a", 2, "", 0, 0), ("b", 1, None, 0, 0), ("c", 5, "one two", 0, 0), ("d", 5, "one two", 0, 0), ("e", None, "ONE two", 0, 0), ("f", 7, "word " * 100_000, 0, 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (5, 5), (None, 5), (7, 7)}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def simple_lines(texts, least=1):
    """Kept lines of (id, text) in order: a line goes if an earlier one has a Jaccard similarity of 0.8 or more."""
    seen, out = [], {}
    for key, text in sorted(texts):
        kept = []
        for line in text.split("\n"):
            words = set(line.lower().split())
            if len(words) >= least:
                if any(10 * len(words & x) >= 8 * len(words | x) for x in seen):
                    seen.append(words)
                    continue
                seen.append(words)
            kept.append(line)
        out[key] = "\n".join(kept)
    return out


def test_op7_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op7_line_dedup(spark, SMALL).collect()
    assert {r.doc_id: r.text for r in rows} == simple_lines(texts)
    for r, text in ((r, dict(texts)[r.doc_id]) for r in rows):
        assert r.n_lines == text.count("\n") + 1
        assert r.n_removed == 0 or r.n_removed == r.n_lines - (r.text.count("\n") + 1) or r.text == ""


def edited_families(n=12):
    rng = np.random.default_rng(5)
    words, texts = [f"w{i}" for i in range(40)], []
    for family in range(6):
        base = rng.choice(words, rng.integers(4, 16)).tolist()
        for _ in range(n):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(len(own))] = f"x{rng.integers(30)}"
            texts.append(" ".join(own))
    texts += [" ".join(f"{w}{i % 3 if i < 60 else 0}" for i in range(90)) for w in ("p", "q", "p")]
    rng.shuffle(texts)
    return [(i, "\n".join(texts[3 * i : 3 * i + 3])) for i in range(len(texts) // 3)]


def test_lines_of_edited_families(spark):
    docs = edited_families()
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == simple_lines(docs)


@pytest.mark.parametrize("first, hot, group", [(1, 0, 4), (1, 255, 4096), (2, 20, 7)])
def test_hot_tokens_and_full_search_lose_no_line(spark, first, hot, group):
    docs = edited_families()
    rows, _ = line_dedup.documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    gone = {(r.id, r.line) for r in line_dedup.removed_lines(rows, first=first, hot=hot, group=group).collect()}
    kept = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in docs}
    assert kept == simple_lines(docs)


def test_unlike_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(7, "a b c d e\nown one"), (7, "own two\nE d c b a"), (7, "own two\nE d c b a"), (None, "x\ny"), (None, "z\nx"), (3, "zz")]
    out = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = {t for k, t in out if k == 7}
    assert len(out) == 6 and texts in ({"a b c d e\nown one", "own two"}, {"own one", "own two\nE d c b a"}) and {t for k, t in out if not k} in ({"x\ny", "z"}, {"y", "z\nx"})


def test_line_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [("a", 2, "one two three four five\nx", 9, 0), ("b", 1, None, 9, 0), ("c", None, "Five four three two one", 9, 0), ("d", 4, "", 9, 0), ("e", 4, "", 9, 0), ("f", 6, long, 9, 0), ("g", 7, f"{long} more\nkeep", 9, 0)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["extra", "doc_id", "text", "id", "fp", "n_lines", "n_removed"]
    got = {(r.extra, r.doc_id): (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got == {("a", 2): ("x", 2, 1), ("b", 1): (None, 0, 0), ("c", None): ("Five four three two one", 1, 0), ("d", 4): ("", 1, 0), ("e", 4): ("", 1, 0), ("f", 6): (long, 1, 0), ("g", 7): ("keep", 2, 1)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(2, 9))
def test_compact_windows_hold_their_minimum(raw, least):
    h = np.array(raw, np.uint64)
    if len(h) < least:
        return
    d, _, first, last = passages.joint_windows(h, np.array([len(h)]), least)
    assert set(d.tolist()) == {0}
    covered = set()
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        assert 0 <= a and b < len(h) and b - a + 1 >= least
        covered |= set(range(a, b - least + 2))
    assert covered == set(range(len(h) - least + 1))


def test_shared_subsequence_shares_signatures():
    rng = np.random.default_rng(2)
    shared_part = rng.integers(0, 2**63, 46).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(20, 90)).astype(np.uint64), shared_part, rng.integers(0, 2**63, 70).astype(np.uint64)]) for _ in range(2))
    d, sig, *_ = passages.joint_windows(np.concatenate([a, b]), np.array([len(a), len(b)]), 46)
    assert len(set(sig[d == 0].tolist()) & set(sig[d == 1].tolist())) >= 2


def test_op3_finds_every_long_repeat(spark):
    texts = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    where = {}
    for key, words in texts.items():
        for i in range(len(words) - 49):
            where.setdefault(" ".join(words[i : i + 50]), set()).add(key)
    repeated = set().union(*(x for x in where.values() if len(x) > 1))
    rows = queries.op3_repeated_passages(spark, SMALL).collect()
    assert repeated <= {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    for r in rows:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.other_doc_id][r.other_start : r.other_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and r.other_doc_id != r.doc_id
        assert len(x & y) >= 0.8 * len(x | y) and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9


def test_passage_edges(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    part, other = words(60), words(60)
    rows = [(1, f"{words(30)} {part} {words(40)}"), (2, f"{part} {words(9)}"), (2, f"{part} {words(9)}"), (3, words(200)), (None, part), (4, None), (5, ""), (6, words(70)), (7, f"{other} {words(50_000)}"), (8, other), (9, f"{other} {other}"), (10, " ".join(part.split()[:49]))]
    found = passages.repeated_passages(spark.createDataFrame([("e", k, t, 0, 0) for k, t in rows], SCHEMA)).collect()
    # the two texts of id 2 are unlike, and so are documents of their own, as is the one without an id
    assert {(r.doc_id, r.other_doc_id) for r in found} == {(2, 1), (2, 2), (2, None), (8, 7), (9, 7)}
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_edited_passages(spark):
    """Passages of 100 words with two words changed (similarity about 0.81): at least nine in ten are found."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for i in range(60):
        part = words(100)
        rows.append((2 * i, " ".join(words(50) + part + words(50))))
        for k in rng.choice(np.arange(10, 90, 10), 2, replace=False):
            part[k] = "changed"
        rows.append((2 * i + 1, " ".join(words(20) + part)))
    found = {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(60)} and len(found) >= 54


def test_members_of_a_group_are_linked_without_its_first(spark):
    """Near copies under a first document that only shares a common part with them, and a chain of which only neighbours match."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    common, rows, want = words(42), [(0, " ".join(words(30)))], set()
    rows[0] = (0, " ".join(words(20)) + " " + " ".join(common) + " " + " ".join(words(20)))
    for i in range(1, 41):
        own = words(20) + common + words(20)
        rows.append((2 * i, " ".join(own)))
        own[5], own[70] = "changed", "changed"
        rows.append((2 * i + 1, " ".join(own)))
        want.add((2 * i + 1, 2 * i))
    for i in range(40):  # c differs from a in one word and b from c in another; a and b have too little in common
        a = words(60)
        c = [*a[:14], "first", *a[15:]]
        rows += [(1000 + 3 * i, " ".join(a)), (1001 + 3 * i, " ".join([*c[:43], "second", *c[44:]])), (1002 + 3 * i, " ".join(c))]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {k: shingles(t) for k, t in rows}
    found = {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= found
    assert len(found & {(1002 + 3 * i, 1001 + 3 * i) for i in range(40)}) >= 32 and not found & {(1001 + 3 * i, 1000 + 3 * i) for i in range(40)}
    assert all(len(sets[a] & sets[b]) >= 41 for a, b in found)


def simple_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=12)), min_size=1, max_size=6))
def test_alignment(pairs):
    best, _ = decontaminate.align([list(a) for a, _ in pairs], [list(b) for _, b in pairs])
    assert best.tolist() == [simple_align(a, b) for a, b in pairs]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_op8_equals_brute_force(spark, sent, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    docs = {r.doc_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    pairs = [(k, i) for k in docs for i in items]
    best, _ = decontaminate.align([items[i] for _, i in pairs], [docs[k] for k, _ in pairs])
    want = {p for p, s in zip(pairs, best.tolist(), strict=True) if s >= 0.5 * 2 * len(items[p[1]])}
    rows = queries.op8_decontamination(spark, SMALL).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want


def test_decontamination_edges(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    item = words(30)
    edited, other = [w for i, w in enumerate(item) if i % 9] + ["new"], words(12)
    texts = [(1, " ".join(words(50) + item + words(50))), (2, " ".join(words(10) + edited)), (3, " ".join(words(100))), (4, None), (None, " ".join(item)), (5, ""), (5, " ".join(item).upper()), (6, " ".join(words(60_000) + item)), (7, " ".join(item[:9] + words(30))), (8, " ".join(other))]
    docs = spark.createDataFrame([("e", k, t, 0, 0) for k, t in texts], SCHEMA)
    items = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "one word", "x"), (None, "", "x"), (None, " ".join(other), "x")], "item_id long, text string, doc_id string")
    out = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (2, 1), (None, 1), (5, 1), (6, 1), (8, None)}
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in decontaminate.decontaminated(docs, items).collect()) == sorted((k, (t or "")[:3]) for k, t in texts if k in (3, 4, 7) or t == "")
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), items).count() == 0


def test_contaminated_classes_hold_in_larger_table(spark):
    rows = queries.op8_decontamination(spark, SF)
    texts = {r.doc_id: " ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {k for k, t in texts.items() if any(i in t for i in items)}
    assert whole <= {r.doc_id for r in rows.select("doc_id").collect()}
    assert rows.where(F.col("score") > 1).count() == 0
