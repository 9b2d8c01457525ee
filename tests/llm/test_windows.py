"""Windows of passages on their way to their groups: only those that two documents share are stored."""

import numpy as np

from tickloom.llm import passages


def texts(seed: int, n: int, part: str = "") -> list[tuple[int, str]]:
    rng = np.random.default_rng(seed)
    return [(10**12 * i - 7, f"{' '.join(f'v{x}' for x in rng.integers(0, 10**9, 90))} {part if i % 2 else ''}") for i in range(n)]


def test_windows_of_one_document_are_not_stored(spark, monkeypatch):
    kept, stored = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    assert passages.repeated_passages(spark.createDataFrame(texts(1, 30), "doc_id long, text string")).count() == 0
    assert kept and sum(x.count() for x in kept) == 0


def test_groups_are_those_of_all_windows(spark, monkeypatch):
    """Also when a group is opened in many parts, and on any number of partitions."""
    part = " ".join(f"common{x}" for x in range(70))
    rows = [*texts(2, 60, part), (-5, f"{part} {part}"), (2**62, part)]
    h, sizes = passages.shingle_hashes([t for _, t in rows])
    d, sig, first, last = passages.joint_windows(h, sizes, 46)
    members = {}
    for k, s, a, b in zip(d.tolist(), sig.tolist(), first.tolist(), last.tolist(), strict=True):
        members.setdefault(s >> 64 - passages.DEALT - passages.LOW, []).append((rows[k][0], a, b))
    want = sorted((s, *w, *min(ws)) for s, ws in members.items() if len({w[0] for w in ws}) > 1 for w in ws)
    docs = spark.createDataFrame(rows, "id long, text string")
    for size, parts in ((passages.PART, 1), (300, 1), (300, 7)):
        monkeypatch.setattr(passages, "PART", size)
        got = passages.groups(passages.windows(docs.repartition(parts), 46)).select("sig", "id", "first", "last", "other", "other_first", "other_last").collect()
        assert sorted(map(tuple, got)) == want and len(want) > 300


def test_packed_rows_come_back():
    rng = np.random.default_rng(3)
    bucket, a, b = rng.integers(0, 5, 500).astype(np.uint64), rng.integers(0, 2**40, 500).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    used, (data, wa, wb) = passages.packed(bucket, [a, b])
    (x, y), n = passages.unpacked(data, [wa[0].as_py(), wb[0].as_py()])
    assert sorted(zip(np.repeat(used, n).tolist(), x.tolist(), y.tolist(), strict=True)) == sorted(zip(bucket.tolist(), a.tolist(), b.tolist(), strict=True))


def test_the_sessions_setting_comes_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    passages.repeated_passages(spark.createDataFrame(texts(1, 3), "doc_id long, text string"))
    assert spark.conf.get(key) == was
