"""Gates, scores, ranks and parameter grids (SURVEY L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Reason codes of the hard gates in order, thresholds, and weights of the scores.
HARD_GATES = (
    ("NONPOSITIVE_BASE_RETURN", "base_return > 0"),
    ("NONPOSITIVE_COST_1_5X_RETURN", "costly_return > 0"),
    ("INSUFFICIENT_TRADES", "trade_count >= 100"),
    ("MAX_DRAWDOWN_EXCEEDED", "max_drawdown <= 0.08"),
    ("PROFIT_FACTOR_TOO_LOW", "profit_factor >= 1.15"),
    ("INSUFFICIENT_PROFITABLE_WF_WINDOWS", "profitable_windows >= 0.6"),
    ("UNSTABLE_PARAMETER_NEIGHBORHOOD", "neighborhood_stable"),
    ("SYMBOL_PROFIT_CONCENTRATION", "symbol_share <= 0.7"),
    ("START_DATE_INSTABILITY", "start_date_stable"),
    ("NULL_TEST_FAILED", "null_test_passed"),
)
SURVIVOR_WEIGHTS = {"return_consistency": 0.30, "drawdown_quality": 0.20, "profit_factor_quality": 0.20, "walk_forward_consistency": 0.20, "cost_resilience": 0.10}
RETURN_SCALE, DRAWDOWN_LIMIT = 0.1, 0.08


def evaluate_gates(evidence: DataFrame, gates: tuple[tuple[str, str], ...] = HARD_GATES, key: str = "strategy_id") -> DataFrame:
    """One row for each candidate and gate, in order; what is missing fails."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("code"), F.coalesce(F.expr(p), F.lit(False)).alias("passed")) for i, (c, p) in enumerate(gates, 1)])
    return evidence.select(key, F.explode(rows).alias("g")).select(key, "g.*")


def decide(gates: DataFrame, key: str = "strategy_id") -> DataFrame:
    """PROMOTE if every gate passed, else REJECT with the failed codes in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ordinal", "code"))))
    return gates.groupBy(key).agg(F.when(F.bool_and("passed"), "PROMOTE").otherwise("REJECT").alias("decision"), F.array_join(F.transform(failed, lambda x: x["code"]), ",").alias("reasons"))


def survivor_scores(evidence: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Score and rank of candidates that passed: validation_* and final_* columns of return, drawdown, profit_factor, sensitivity; wf_share."""
    quality = lambda r: F.col(r) / (RETURN_SCALE + F.col(r))
    v, f = quality("validation_return"), quality("final_return")
    factor = lambda c: (F.col(c) - 1) / F.col(c)
    parts = {
        "return_consistency": 2.0 * v * f / (v + f),
        "drawdown_quality": 1.0 - F.least(F.greatest("validation_drawdown", "final_drawdown") / DRAWDOWN_LIMIT, F.lit(1.0)),
        "profit_factor_quality": (factor("validation_profit_factor") + factor("final_profit_factor")) / 2.0,
        "walk_forward_consistency": F.col("wf_share"),
        "cost_resilience": 1.0 - F.greatest("validation_sensitivity", "final_sensitivity"),
    }
    score = reduce(lambda a, b: a + b, [parts[k] * w for k, w in SURVIVOR_WEIGHTS.items()])
    scored = evidence.select(key, *[p.alias(k) for k, p in parts.items()], score.alias("score"))
    return ranked(scored, "score", key)


def ranked(rows: DataFrame, score: str, key: str, parts: int = 100) -> DataFrame:
    """rows with `rank` over all of them, by falling score, then key. Rows are ranked within parts between approximate percentiles, and each part
    begins after the counts of those before it, so no task orders more than a part of them (ties of one score stay in one part). A null score is last."""
    bounds = rows.agg(F.coalesce(F.percentile_approx(F.col(score), [i / parts for i in range(1, parts)]), F.array().cast("array<double>")).alias("_bounds"))
    placed = rows.join(F.broadcast(bounds)).withColumn("_part", F.when(F.col(score).isNull(), parts).otherwise(F.size(F.filter("_bounds", lambda b: b > F.col(score))))).drop("_bounds")  # one row
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # as many rows as parts
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc_nulls_last(score), key))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + own).cast("int")).drop("_part", "_before")


def rank_scores(metrics: DataFrame, weights: dict[str, float], lower_is_better: frozenset[str], cohort: str, key: str = "strategy_id") -> DataFrame:
    """Cross-sectional score: each component gives 1 - position / (distinct values - 1) within the cohort; ties in score go by key."""
    rows = metrics.unpivot([cohort, key], [F.col(c).cast("double").alias(c) for c in sorted(weights)], "component", "value")
    signed = F.when(F.col("component").isin(*lower_is_better), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(cohort, "component")
    rows = rows.withColumn("position", F.dense_rank().over(w.orderBy(signed)) - 1)
    rows = rows.withColumn("values", F.max("position").over(w))
    weight = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("component"))
    part = F.when(F.col("values") == 0, 1.0).otherwise(1.0 - F.col("position") / F.nullif(F.col("values"), F.lit(0)))
    scored = rows.groupBy(cohort, key).agg(F.round(F.sum(part * weight), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc("score"), key)))


def within_capacity(df: DataFrame, capacity: dict[str, int], state: str, order: list[Column]) -> DataFrame:
    """The first rows of each state, as many as its capacity."""
    most = F.element_at(F.create_map(*[x for k, v in capacity.items() for x in (F.lit(k), F.lit(v))]), F.col(state))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(state).orderBy(*order))).where(F.col("_r") <= max(capacity.values())).where(F.col("_r") <= most).drop("_r")


def parameter_grid(spark: SparkSession, ranges: dict[str, list]) -> DataFrame:
    """The product of the sorted values by mixed-radix rank: variant_rank and a column for each parameter, made by the tasks that need it."""
    total = 1
    for values in ranges.values():
        total *= len(values)
    rest, columns = F.col("id"), []
    for name in sorted(ranges, reverse=True):
        values = sorted(ranges[name])
        columns.append(F.element_at(F.array(*map(F.lit, values)), (rest % len(values) + 1).cast("int")).alias(name))
        rest = F.floor(rest / len(values))
    return spark.range(total).select(F.col("id").alias("variant_rank"), *reversed(columns))


def variants(grid: DataFrame) -> DataFrame:
    """Each parameter row's document and its SHA-256; of equal documents the first stays."""
    names = sorted(c for c in grid.columns if c != "variant_rank")
    rows = grid.select("variant_rank", F.to_json(F.struct(*names)).alias("document")).withColumn("content_sha256", F.sha2("document", 256))
    first = Window.partitionBy("content_sha256").orderBy("variant_rank")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def farthest_points(grid: DataFrame, budget: int, key: str = "hypothesis_id") -> DataFrame:
    """`budget` rows of each hypothesis: the least parameter row first, then each time the row farthest from those chosen (sum of
    distances scaled to each parameter's range; ties by parameters). Each hypothesis's pool is a group of its own and bounded."""
    import numpy as np
    import pandas as pd

    names = sorted(c for c in grid.columns if c not in (key, "variant_rank"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(names, kind="stable").reset_index(drop=True)
        x = frame[names].to_numpy(float)
        span = np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1)
        x, chosen, near = (x - x.min(axis=0)) / span, [0], None
        while len(chosen) < min(budget, len(x)):
            d = np.abs(x - x[chosen[-1]]).sum(axis=1)
            near = d if near is None else np.minimum(near, d)
            near[chosen] = -1
            chosen.append(int(near.argmax()))
        return frame.iloc[chosen]

    return grid.groupBy(key).applyInPandas(choose, grid.schema)


def gate_then_rank(evidence: DataFrame, hard: tuple[tuple[str, str], ...], weights: dict[str, float], lower_is_better: frozenset[str], cohort: str, key: str) -> DataFrame:
    """rank_scores of those candidates alone that pass every gate."""
    passed = decide(evaluate_gates(evidence, hard, key), key).where("decision = 'PROMOTE'").select(key)
    return rank_scores(evidence.join(passed, key, "left_semi").select(cohort, key, *weights), weights, lower_is_better, cohort, key)


def prime_from(n: int) -> int:
    """The least prime that is n or more (n below 2**64)."""

    def prime(x: int) -> bool:
        if x < 2 or any(x % p == 0 and x != p for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
            return False
        d, s = x - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):  # enough below 2**64
            if a % x == 0:
                continue
            y = pow(a, d, x)
            if y in (1, x - 1):
                continue
            for _ in range(s - 1):
                y = y * y % x
                if y == x - 1:
                    break
            else:
                return False
        return True

    while not prime(n):
        n += 1
    return n


def pool_ranks(total: int, size: int, seed: int) -> list[int]:
    """`size` distinct ranks below total in a fixed order, as a keyed permutation of range(total) has them: nothing of the grid but these is
    ever made. The permutation is x -> (a x + b) ** e modulo the next prime, walked on while it leaves the range."""
    if total <= size:
        return list(range(total))
    p = prime_from(total)
    e = next(k for k in (5, 7, 11, 13, 17, 19, 23, 29, 31, 37) if (p - 1) % k)
    a, b = seed * 2_654_435_761 % (p - 1) + 1, (seed + 1) * 40_503 % p

    def moved(x: int) -> int:
        while True:
            x = pow((a * x + b) % p, e, p)
            if x < total:
                return x

    return [moved(r) for r in range(size)]


def spread_variants(hypotheses: DataFrame, key: str = "hypothesis_id", least_pool: int = 256) -> DataFrame:
    """(key, ordinal, reason, parameters as JSON): up to `budget` variants of each hypothesis, spread over its grid of parameters.

    hypotheses: key, ranges (map of a parameter to its values), baseline (map of a parameter to one), budget, seed. The baseline, the lowest and
    the highest corner come first; then, of a pool of max(least_pool, 8 budget) cells drawn by a keyed permutation of the cells' ranks, each
    time the cell farthest from the nearest chosen one (by places in the ranges, each from 0 to 1; ties go to the earlier in the pool). A grid of
    no more cells than the budget comes whole, in order. Work and memory follow the pool, whatever the grid's size. A hypothesis without ranges,
    or whose baseline lacks a parameter, gives no rows.
    """
    import json
    from collections.abc import Iterator
    from itertools import product

    import numpy as np
    import pyarrow as pa

    kind = dict(hypotheses.dtypes)[key]

    def chosen(ranges: dict, baseline: dict, budget: int, seed: int) -> list[tuple[str, dict]]:
        names = sorted(ranges)
        values = [sorted(set(ranges[n])) for n in names]
        if not names or any(not v for v in values) or any(n not in baseline for n in names):
            return []
        forced: dict[tuple, str] = {}
        for cell, reason in ((tuple(baseline[n] for n in names), "baseline"), (tuple(v[0] for v in values), "lower_boundary"), (tuple(v[-1] for v in values), "upper_boundary")):
            forced.setdefault(cell, reason)
        total = 1
        for v in values:
            total *= len(v)
        if total <= budget:
            rest = [c for c in product(*values) if c not in forced]
            return [(r, dict(zip(names, c, strict=True))) for c, r in (*forced.items(), *((c, "space_filling") for c in rest))][: max(budget, len(rest) + len(forced))]
        taken = list(forced)[:budget]
        pool = []
        for rank in pool_ranks(total, max(least_pool, 8 * budget), seed):
            cell = []
            for v in reversed(values):
                rank, i = divmod(rank, len(v))
                cell.append(v[i])
            pool.append(tuple(reversed(cell)))
        pool = [c for c in dict.fromkeys(pool) if c not in forced]
        place = [{x: i / max(1, len(v) - 1) for i, x in enumerate(v)} for v in values]
        near_place = lambda x, p, v: p[x] if x in p else float(np.searchsorted(v, x)) / max(1, len(v) - 1)  # noqa: E731  a baseline off the grid
        at = lambda c: np.array([near_place(x, p, v) for x, p, v in zip(c, place, values, strict=True)])
        cells = np.array([at(c) for c in pool]).reshape(len(pool), len(names))
        near = np.full(len(pool), np.inf)
        out, used = [(forced[c], c) for c in taken], np.zeros(len(pool), bool)
        for c in taken:
            near = np.minimum(near, np.abs(cells - at(c)).sum(axis=1))
        while len(out) < budget and not used.all():
            best = int(np.where(used, -1.0, np.round(near, 9)).argmax())
            used[best] = True
            out.append(("space_filling", pool[best]))
            near = np.minimum(near, np.abs(cells - cells[best]).sum(axis=1))
        return [(r, dict(zip(names, c, strict=True))) for r, c in out]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, ranges, baseline, budget, seed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found = chosen(dict(ranges or {}), dict(baseline or {}), budget or 0, seed or 0)
                rows += [(own, i, reason, json.dumps(cell, sort_keys=True)) for i, (reason, cell) in enumerate(found)]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string()), strict=True)], ["id", "ordinal", "reason", "parameters"])

    rows = hypotheses.select(F.col(key).alias("id"), F.col("ranges").cast("map<string,array<double>>").alias("ranges"), F.col("baseline").cast("map<string,double>").alias("baseline"), F.col("budget").cast("int").alias("budget"), F.col("seed").cast("long").alias("seed"))
    return rows.mapInArrow(run, f"id {kind}, ordinal int, reason string, parameters string").withColumnRenamed("id", key)
