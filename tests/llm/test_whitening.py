"""Whitening against exact rational arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """(x, n, S, V) of the distinct counted vectors."""
    x = sorted({tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v) for v in vectors})
    n, dim = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(dim)]
    cov = [[Fraction(sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in x), n**3) for b in range(dim)] for a in range(dim)]
    return x, n, s, np.array([[float(c) for c in row] for row in cov])


def test_equals_rational_arithmetic(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    _, n, s, cov = plain(table["embedding"])
    values, frame = np.linalg.eigh(cov)
    values, frame = values[::-1], frame[:, ::-1]
    got = queries.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(table) and set(got["n"]) == {n}
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in table.sort_values("vec_id")["embedding"]])
    want = ((n * x - np.array(s)) / n) @ (frame[:, :16] / np.sqrt(values[:16]))
    found = got["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((want * found).sum(axis=0))
    assert np.allclose(found * signs, want, atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), values[:16] / np.trace(cov), rtol=1e-9)
    assert (got["deviation"].to_numpy()[::16] == ((n * x - np.array(s)) ** 2).sum(axis=1)).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got["component"].tolist() == list(range(1, 17)) * len(table)


def rows_of(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "vec_id long, embedding array<double>, component string, x double")


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    whole = [(1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (2, [1.0, 0.5, -2.0]), (None, [0.25, 0.0, 4.0]), (4, [1.5, 1.0, 0.0]), (5, [-1.0, 3.0, 0.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 0.0, 0.0]), (10, [inf, 0.0, 0.0]), (11, [-inf, 0.0, 0.0]), (12, [1.0, 2.0])]
    got = whitening.whitened(rows_of(spark, whole + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in whole for c in (1, 2, 3))
    assert {r.n for r in got} == {5} and max(r.identity_error for r in got) < 1e-9
    one = [r for r in got if r.vec_id == 1 and r.component == 1]
    assert len(one) == 2 and one[0] == one[1]
    assert whitening.whitened(rows_of(spark, [])).collect() == []
    assert whitening.whitened(rows_of(spark, bad[:2])).collect() == []
    assert whitening.whitened(rows_of(spark, whole[:2])).collect() == []  # one distinct vector: no variance
    flat = whitening.whitened(rows_of(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e6, 2.0**40]), (2, [-1e6, 3.0]), (3, [0.5, -(2.0**41)]), (4, [1e300, 0.0])]
    got = {r.vec_id: r for r in whitening.whitened(rows_of(spark, rows[:3]), 1).collect()}
    x, n, s, _ = plain([v for _, v in rows[:3]])
    for i, v in rows[:3]:
        own = [int(np.floor(64 * c)) + 1_000_000 for c in v]
        assert got[i].deviation == min(sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True)), 2**63 - 1)
    held = whitening.whitened(rows_of(spark, [(i, [v[0]]) for i, v in rows]), 1).collect()  # one entry beyond 2**62 is held there
    assert len(held) == 4 and max(r.deviation for r in held) == 2**63 - 1


def test_square_sums_are_exact():
    rng = np.random.default_rng(0)
    for bits in (3, 30, 45, 60):
        x = rng.integers(-(2**bits), 2**bits, (1000, 3))
        assert whitening.square_sums(x) == [sum(int(v) ** 2 for v in column) for column in x.T]


def test_packing_keeps_rows_apart():
    x = np.array([[1, -2], [2**15, 0], [-(2**15), 2**15 - 1], [2**31, 5], [-(2**31), 1], [2**62, -(2**62)]])
    packed = whitening.packed(x)
    assert [len(p) for p in packed] == [4, 8, 4, 16, 8, 16]
    assert (whitening.unpacked(packed, 2) == x).all()
