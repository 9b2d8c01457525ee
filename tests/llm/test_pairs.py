"""Comparison of pairs of documents: dealt so that a document goes to a piece once, in one pass over codes of shingles."""

import numpy as np

from tickloom.llm import passages


def plain(x, at_x, y, at_y, least, tenths):
    """compare by sets."""
    shared, out = np.isin(x, y), []
    need = -(-2 * tenths * least // (10 + tenths))
    held = set()
    for i in range(len(x) - least + 1):
        if shared[i : i + least].sum() >= need and at_x[i + least - 1] - at_x[i] == least - 1:
            held.update(j for j in range(i, i + least) if shared[j])
    hit = sorted(held)
    todo = [r.tolist() for r in np.split(np.array(hit, int), np.flatnonzero(np.diff(at_x[hit]) > least) + 1) if len(r)]
    while todo:
        run = todo.pop()
        a, b = at_x[run[0]], at_x[run[-1]]
        if b - a + 1 < least:
            continue
        sx, found = set(x[run[0] : run[-1] + 1].tolist()), []
        there = np.array([j for j, v in enumerate(y.tolist()) if v in sx], int)
        for part in np.split(there, np.flatnonzero(np.diff(at_y[there]) > 2 * passages.SHINGLE) + 1):
            sy = set(y[part[0] : part[-1] + 1].tolist())
            both = len(sx & sy)
            if at_y[part[-1]] - at_y[part[0]] + 1 >= least and 10 * both >= tenths * len(sx | sy):
                found.append((int(a), int(b), int(at_y[part[0]]), int(at_y[part[-1]]), both / len(sx | sy)))
        out += found
        apart = np.diff(at_x[run])
        if not found and len(apart) and apart.max() > 1:
            cut = int(apart.argmax()) + 1
            todo += [run[:cut], run[cut:]]
    return out


def test_compare_is_that_of_sets():
    rng, hits = np.random.default_rng(1), 0
    for k in range(300):
        x = rng.integers(0, 400, rng.integers(1, 300))
        y = np.concatenate([rng.integers(0, 400, rng.integers(0, 60)), np.where(rng.random(len(x)) < rng.choice([0.0, 0.02, 0.08, 0.2]), rng.integers(0, 400, len(x)), x), rng.integers(0, 400, rng.integers(0, 60))])
        at_x, at_y = (np.sort(rng.choice(len(z) + 5 * (k % 2), len(z), replace=False)) for z in (x, y))
        least = int(rng.choice([5, 20, 46]))
        got = passages.compare(x, at_x, y, at_y, least, 8, passages.Marks(400))
        assert got == plain(x, at_x, y, at_y, least, 8)
        hits += bool(got)
    assert hits > 50


def test_spans_of_many_rows_are_merged():
    rng = np.random.default_rng(2)
    rows = [[int(a) << 32 | int(a + b) for a, b in zip(rng.integers(0, 200, n), rng.integers(0, 30, n), strict=True)] for n in rng.integers(0, 9, 200)]
    spans, n = passages.merged_rows(np.array([s for r in rows for s in r], np.int64), np.array([len(r) for r in rows]))
    want = [passages.merged(r) for r in rows]
    assert n.tolist() == [len(w) for w in want] and spans.tolist() == [a << 32 | b for w in want for a, b in w]
    assert [x.tolist() for x in passages.merged_rows(np.zeros(0, np.int64), np.zeros(2, np.int64))] == [[], [0, 0]]


def test_a_document_goes_to_a_piece_once(spark):
    """Whatever number of pairs name it: of 200 documents, all pairs, and of one first document with 3,000 others."""
    family = [(i, j) for i in range(200) for j in range(i)]
    pairs = [*family, *((10_000 + i, 5_000) for i in range(3_000))]
    frame = spark.createDataFrame([(i, j, [50], [50]) for i, j in pairs], "id long, other long, spans array<long>, other_spans array<long>")
    dealt = passages.dealt(frame).select("piece", "id", "other").collect()
    assert sorted((r.id, r.other) for r in dealt) == sorted(pairs)
    sent = {(r.piece, x) for r in dealt for x in (r.id, r.other)}
    assert len(sent) < len(pairs) / 3  # twice as many as pairs before
    assert max(np.unique([r.piece for r in dealt], return_counts=True)[1]) < 4 * passages.PIECE


def test_copies_are_not_compared_with_each_other(spark):
    """Copies under many first documents that match none of them: each is linked with the first copy, which alone meets the other texts."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    common = words(49)  # one shingle less than a passage
    own = words(40) + common + words(40)
    near = [*own[:10], "changed", *own[11:]]
    rows = [(i, " ".join(words(30) + common + words(30))) for i in range(12)]
    rows += [(100 + i, " ".join(own)) for i in range(30)] + [(200, " ".join(near))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = {(r.doc_id, r.other_doc_id) for r in found}
    assert links == {(i, 100) for i in [*range(101, 130), 200]}
    assert all(r.start == r.other_start == 0 and r.end == r.other_end == 129 and r.similarity == 1 for r in found if r.doc_id < 200)
