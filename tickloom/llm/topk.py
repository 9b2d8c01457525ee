"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash. In a block, each dimension has its candidates sorted; a query walks all its lists in step
(from the top for a positive component, from the bottom for a negative one), scores every candidate it meets in full, and stops when
the sum of the current list values, which no unmet candidate can beat, is below its k-th score. Blocks of queries meet blocks of
candidates in an equi-join on block numbers; each query's best of all blocks are then ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products of integers below this sum exactly in doubles.
EXACT = 2.0**53
#: Scores are 64-bit integers.
LEAST, MOST = -(2**63), 2**63 - 1


def whole(x: np.ndarray) -> np.ndarray:
    """The same integers without a limit of size."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class SortedLists:
    """A block's candidates: ids, integer vectors (a row each), and each dimension's candidates in falling order of value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.falling = np.argsort(-self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.falling, axis=0)
        self.top = float(np.abs(self.vectors).max(initial=0))

    def search(self, query: np.ndarray, k: int, own: int | None, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, higher scores first, then smaller ids; the row with id `own` takes no part."""
        n, used = len(self.ids), np.flatnonzero(query)
        exact = self.top * float(np.abs(query).sum()) < EXACT
        vectors = self.vectors if exact else whole(self.vectors)
        weights = query if exact else whole(query)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
        depth, up = 0, query[used] > 0
        if not len(used):
            depth, best_ids = n, self.ids[~seen][:k]
            best = np.zeros(len(best_ids), vectors.dtype)
        while depth < n:
            end = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.falling[depth:end, used[up]].ravel()] = True
            met[self.falling[n - end : n - depth, used[~up]].ravel()] = True
            rows = np.flatnonzero(met & ~seen)
            seen[rows] = True
            if len(rows):
                scores = vectors[rows] @ weights
                if not exact:
                    scores = np.array([min(max(x, LEAST), MOST) for x in scores], object)
                if len(best) == k and exact:
                    rows, scores = rows[scores >= best[-1]], scores[scores >= best[-1]]
                best_ids, best = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, scores])
                order = np.lexsort((best_ids, -best))[:k] if exact else sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k]
                best_ids, best = best_ids[order], best[order]
            depth, step = end, 2 * step
            if depth < n and len(best) == k:
                at = np.where(up, depth - 1, n - depth)
                edge = self.values[at, used]
                bound = edge @ query[used] if exact else sum(int(a) * int(b) for a, b in zip(edge, query[used], strict=True))
                if bound < best[-1]:
                    break
        return best_ids, best


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as doubles, at the nearer end of 64-bit integers where it lies beyond. Rows with a null id
    or vector, or a null or non-finite component, go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int = 8192, query_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k best inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those with the query's own id. Fewer than k candidates give fewer rows; an empty
    vector scores 0 with any other of its length; vectors of different lengths never meet; a query id that is repeated is asked once, with
    its smallest vector; other columns are not read. Null vectors, and such with null or non-finite components, take no part. Components and
    scores beyond 64-bit integers are taken as the nearer end of these, so such scores tie.

    A block of candidates is read once for each query_block queries, its lists are sorted once for them.
    """
    v = integer_vectors(rows, scale, id_col, vector_col)
    n = v.count()
    parts, query_parts = -(-n // block) or 1, -(-n // (every * query_block)) or 1
    to_block = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    lists = v.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"))
    lists = lists.groupBy("dim", "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vectors"))
    asked = v.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.size("v").alias("dim"), to_block(query_parts, "q").alias("q_part"))
    asked = asked.groupBy("dim", "q_part").agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q_vectors"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = asked.join(lists, ["dim", "part"])

    def search(pair: pa.Table) -> pa.Table:
        dim, ids, q_ids = pair["dim"][0].as_py(), pair["ids"][0].values.to_numpy(), pair["q_ids"][0].values.to_pylist()
        own = SortedLists(ids, pair["vectors"][0].values.to_numpy(zero_copy_only=False).reshape(len(ids), dim))
        queries = pair["q_vectors"][0].values.to_numpy(zero_copy_only=False).reshape(len(q_ids), dim)
        found = [(q, *own.search(x, k, q)) for q, x in zip(q_ids, queries, strict=True)]
        out = [[q for q, i, _ in found for _ in i], [int(x) for _, i, _ in found for x in i], [int(x) for _, _, s in found for x in s]]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "id", "score"), out, strict=True)})

    # a group is one row, a block of queries with a block of candidates, so a task holds one pair at a time
    near = met.groupBy("dim", "part", "q_part").applyInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
