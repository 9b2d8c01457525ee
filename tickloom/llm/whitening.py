"""Whitened embeddings, with a covariance by polarisation.

Entries become integers, so sums are exact. For every dimension and every sum of two dimensions the squared centred values are added up;
half the difference of the pair's sum and its two dimensions' sums is their cross-covariance. The matrix of these is small and goes through
eigh on the driver; the rows are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored

#: Parts of 1 that an entry is counted in, and what is added to the count.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are squared together.
ROWS = 4096
#: Integers are sent in parts below this.
LIMB = 10**18
#: Counts are held at this size at either end.
MOST = 2**62


def counted(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * c) of finite entries, a row for each vector."""
    return np.clip(np.floor(flat.astype(np.float64).reshape(-1, dim) * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers of the least of 2, 4 and 8 bytes that hold it: equal rows, and no others, give equal bytes."""
    width = np.full(len(rows), 2)
    low, high = rows.min(axis=1, initial=0), rows.max(axis=1, initial=0)
    for bits in (16, 32):
        width[(low < -(2 ** (bits - 1))) | (high >= 2 ** (bits - 1))] = bits // 4
    out: list = [None] * len(rows)
    for w in (2, 4, 8):
        at = np.flatnonzero(width == w)
        data, step = rows[at].astype(f"<i{w}").tobytes(), w * rows.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = data[k * step : (k + 1) * step]
    return out


def unpacked(values: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(values), dim), np.int64)
    size = np.fromiter(map(len, values), np.int64, len(values)) // dim
    for w in (2, 4, 8):
        at = np.flatnonzero(size == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[i] for i in at.tolist()), f"<i{w}").reshape(-1, dim)
    return out


def centred(rows: np.ndarray, n: int, sums: list[int], spread: int) -> np.ndarray:
    """n * x - S: in 64-bit integers where they hold it and twice it, else in Python's. spread bounds it."""
    if spread < 2**61:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, dtype=object)


def square_sums(x: np.ndarray) -> list[int]:
    """The exact sum of squares of each column.

    Of 64-bit integers the sum is taken modulo 2**64 and as a double; the double tells the multiple of 2**64, as its error is far below it.
    """
    if x.dtype == object or not len(x):
        return [int(sum(v * v for v in column)) for column in x.T]
    rough = x.astype(np.float64)
    rough = np.einsum("ij,ij->j", rough, rough)
    if rough.max(initial=0) > 1e30:
        return square_sums(x.astype(object))
    low = np.einsum("ij,ij->j", x.view(np.uint64), x.view(np.uint64))
    return [a + ((int(b) - a + 2**63) >> 64 << 64) for a, b in zip(low.tolist(), rough.tolist(), strict=True)]


def limbs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """(a, b, part, v): each exact integer (a, b, q) in parts of 18 digits, so Spark adds integers of any size."""
    out = []
    for a, b, q in rows:
        part = 0
        while abs(q) >= LIMB:
            q, v = divmod(q, LIMB)
            out.append((a, b, part, v))
            part += 1
        out.append((a, b, part, q))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["a", "b", "part", "v"])


def added(df: DataFrame, run) -> dict[tuple[int, int], int]:
    """The sums of what `run` makes of each partition of df; as many as the dimension's pairs at the most."""
    parts = df.mapInArrow(run, "a int, b int, part int, v long").groupBy("a", "b", "part").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        out[r.a, r.b] = out.get((r.a, r.b), 0) + int(r.v) * LIMB**r.part
    return out


def vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the rows whose vector is whole, x packed, and the dimension: that of the longest vector without null or non-finite entries.
    A shorter vector lacks entries and is dropped, too."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(whole, F.lit(False)))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(counted(flat, dim)), pa.binary())], ["id", "x"])

    return rows.where(F.size("v") == dim).mapInArrow(run, "id long, x binary"), dim


class Whitening:
    """n, the sums, and the projection on the components with positive variance; all as large as the dimension, not the table."""

    def __init__(self, n: int, sums: list[int], spread: int, covariance: np.ndarray, components: int):
        self.n, self.sums, self.spread = n, sums, spread
        values, frame = np.linalg.eigh(covariance)
        values, frame = values[::-1], frame[:, ::-1]
        positive = values > len(values) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
        self.kept = int(min(components, positive.sum()))
        self.explained = values[: self.kept] / np.trace(covariance) if self.kept else values[:0]
        self.projection = frame[:, : self.kept] / np.sqrt(values[: self.kept])

    def of(self, d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / self.n) @ self.projection


def fit(distinct: DataFrame, dim: int, components: int) -> Whitening | None:
    """The whitening of a table of distinct packed vectors; None if it is empty."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, [0] * dim, 0
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dim)
            n += len(x)
            high, low = x >> 31, x & (2**31 - 1)  # two halves, so 64 bits hold their sums
            sums = [s + (int(a) << 31) + int(b) for s, a, b in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
            most = max(most, int(np.abs(x).max(initial=0)))
        yield limbs([(-1, 0, n), *((j, 0, v) for j, v in enumerate(sums)), *((-2, k, 1) for k in range(most.bit_length() + 1))])

    found = added(distinct, add)
    n = found.get((-1, 0), 0)
    if not n:
        return None
    sums, spread = [found[j, 0] for j in range(dim)], 2 * n << max(k for i, k in found if i == -2)

    def squares(batches) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim - j) for j in range(dim)]  # at [j][0] those of dimension j, at [j][k] those of the sum of j and j + k
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                d = centred(unpacked(batch.column(0).slice(at, ROWS).to_pylist(), dim), n, sums, spread)
                for j in range(dim):
                    own = d[:, j:].copy()
                    own[:, 1:] += d[:, j : j + 1]
                    total[j] = [a + b for a, b in zip(total[j], square_sums(own), strict=True)]
        yield limbs([(j, j + k, q) for j in range(dim) for k, q in enumerate(total[j])])

    q = added(distinct, squares)
    covariance = np.zeros((dim, dim))
    for (a, b), pair in q.items():
        twice = 2 * pair if a == b else pair - q[a, a] - q[b, b]
        covariance[a, b] = covariance[b, a] = float(Fraction(twice, 2 * n**3))
    return Whitening(n, sums, spread, covariance, components)


def identity_error(distinct: DataFrame, dim: int, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = w.kept

    def run(batches) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = w.of(centred(unpacked(batch.column(0).to_pylist(), dim), w.n, w.sums, w.spread))
            first += z.sum(axis=0)
            second += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], ["i", "v"])

    v = np.zeros(k + k * k)
    for r in distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        v[r.i] = r.v
    mean = v[:k] / w.n
    return float(np.abs(v[k:].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each whole vector and each of the first components: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, shorter than the longest, or hold null or non-finite entries are dropped; equal rows each give their rows but are
    fitted on once; a null id stays null; other columns are not read. A component without variance (an eigenvalue of not more than rounding
    leaves) can't be whitened and gives no rows, so a table of one distinct vector, or an empty one, gives none. Counts of entries are held at
    2**62 at either end, and a deviation at 2**63 - 1; sums of squares are exact whatever their size.
    """
    rows, dim = vectors(df, id_col, vector_col)
    distinct = stored(rows.select("x").distinct(), "distinct-vectors") if dim else rows.select("x").limit(0)
    w = fit(distinct, dim, components) if dim else None
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not w.kept:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(distinct, dim, w)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = centred(unpacked(part.column(1).to_pylist(), dim), w.n, w.sums, w.spread)
                many, k = part.num_rows, w.kept
                if d.dtype != object and dim * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
                    deviation = np.einsum("ij,ij->i", d, d)
                else:
                    deviation = np.array([min(x, 2**63 - 1) for x in square_sums(d.T.astype(object))], np.int64)
                take = pa.array(np.repeat(np.arange(many), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, w.n)), pa.array(np.repeat(deviation, k)), pa.array(w.of(d).ravel()), pa.array(np.tile(w.explained, many)), pa.array(np.full(many * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
