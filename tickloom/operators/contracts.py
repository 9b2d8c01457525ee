"""What rows of the library's tables must keep to, as rules over their columns, and the rows that do not.

A rule is a predicate that Spark and other SQL engines read alike; null means that it does not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import evidence, nulls

FINITE = "{0} IS NOT NULL AND {0} > -1e300 AND {0} < 1e300"
CONTRACTS = {
    # order_type, limit_price, requested, filled
    "order_intent": {"limit_price_iff_limit": "(order_type = 'limit') = (limit_price IS NOT NULL)", "filled_within_requested": "filled <= requested"},
    # quantity, filled, average_price, submitted_at, updated_at
    "broker_order": {"filled_within_quantity": "filled BETWEEN 0 AND quantity", "updated_after_submitted": "updated_at >= submitted_at", "price_when_filled": "(filled > 0) = (average_price IS NOT NULL)"},
    # status, entries_allowed, exits_allowed
    "permissions": {"entries_only_when_clean": "NOT entries_allowed OR status = 'clean'", "exits_always": "exits_allowed"},
    # status, files
    "result_files": {"succeeded_has_three": "status <> 'succeeded' OR files >= 3", "failed_has_none": "status <> 'failed' OR files = 0"},
    # quantity, entry_price, exit_price, entry_time, exit_time, cost_paid, net_pnl
    "trade": {"positive_quantity": "quantity > 0", "positive_entry_price": "entry_price > 0", "positive_exit_price": "exit_price > 0", "exit_after_entry": "exit_time >= entry_time", "cost_not_negative": "cost_paid >= 0", "finite_pnl": FINITE.format("net_pnl")},
    # equity, gross_exposure
    "equity_point": {"finite_equity": FINITE.format("equity"), "exposure_not_negative": "gross_exposure >= 0"},
    # first_ts, last_ts
    "range": {"min_before_max": "first_ts <= last_ts"},
    # from_state, to_state, refs (how many there are)
    "registry_event": {"state_changes": "from_state IS NULL OR from_state <> to_state", "has_refs": "refs > 0"},
    # net returns, profit factors and drawdowns of validation and final phase, copies (rows of the id)
    "ranking_input": {"positive_returns": "validation_return > 0 AND final_return > 0", "profit_factor_at_least_one": "validation_profit_factor >= 1 AND final_profit_factor >= 1", "bounded_drawdown": "validation_drawdown BETWEEN 0 AND 0.08 AND final_drawdown BETWEEN 0 AND 0.08", "unique": "copies = 1"},
    # scenarios, metrics (named ones that are not null, the least of the scenarios), finite, symbols
    "phase_evidence": {"three_scenarios": "scenarios = 3", "required_metrics": "metrics >= 4", "finite": "finite", "all_symbols": "symbols = 3"},
    # methods, shortest and longest number of repetitions, counts that are negative, passed, profit, threshold
    "null_evidence": {"two_methods": "methods = 2", "one_length": "shortest = longest", "counts_not_negative": "negative = 0", "verdict_agrees": "passed = (profit > threshold)"},
}


def faults(rows: DataFrame, contract: str, key: str) -> DataFrame:
    """(key, check): a row for each row and rule of the contract that it breaks."""
    return evidence.offending(rows, CONTRACTS[contract], key)


def ranking_inputs(rows: DataFrame, key: str) -> DataFrame:
    """rows with `copies`, as the contract of ranking inputs reads it."""
    return rows.withColumn("copies", F.count("*").over(Window.partitionBy(key)))


def null_evidence(scores: DataFrame, key: str = "strategy_id", p: float = 0.95) -> DataFrame:
    """One row for each candidate of null_scores' rows, as the contract of null evidence reads it; `threshold` is the greater one of the methods'
    nearest ranks, and `passed` what each method says on its own."""
    seen = F.col("method") == nulls.OBSERVED
    by = scores.where(~seen).groupBy(key, "method").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("profit")).alias("all"))  # as many as repetitions
    by = by.withColumn("threshold", F.element_at("all", F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("int")))
    own = scores.where(seen).select(key, "profit")
    negative = scores.groupBy(key).agg(F.count_if((F.col("accepted") < 0) | (F.col("rejected") < 0)).alias("negative"))
    met = by.join(own, key).groupBy(key, "profit").agg(F.countDistinct("method").alias("methods"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.max("threshold").alias("threshold"), F.bool_and(F.col("profit") > F.col("threshold")).alias("passed"))
    return met.join(negative, key)


def forward_faults(days: DataFrame, trades: DataFrame, key: str = "strategy_id") -> DataFrame:
    """(strategy, check, n) of forward evidence: DUPLICATE_DAY, DUPLICATE_TRADE, OTHER_STRATEGY (a trade whose strategy has no days) and
    OUTSIDE_COMPLETED_DAYS. days: key, session_date; trades: key, trade_id, session_date."""
    own = days.select(key, "session_date").distinct()
    twice = lambda df, *keys: df.groupBy(key, *keys).count().where("count > 1").groupBy(key).agg(F.count("*").alias("n"))
    named = trades.join(days.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    away = trades.join(own.select(key).distinct(), key, "left_semi").join(own, [key, "session_date"], "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    parts = [(twice(days, "session_date"), "DUPLICATE_DAY"), (twice(trades, "trade_id"), "DUPLICATE_TRADE"), (named, "OTHER_STRATEGY"), (away, "OUTSIDE_COMPLETED_DAYS")]
    out = [df.select(key, F.lit(code).alias("check"), "n") for df, code in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def promotion_events(ranked: DataFrame, capacity: int, components: list[str], state: str = "paper_observing", to: str = "paper_active", key: str = "strategy_id", cohort: str = "cohort") -> DataFrame:
    """Promotion events of the first `capacity` ranked rows of each cohort: event_id (a hash of cohort, id and rank), from_state, to_state,
    reason_code and refs, a JSON object of the score and its components as numbers in text.

    ranked: cohort, key, rank, score, components. A row whose `state` column (if there is one) is another state gives none.
    """
    number = lambda c: F.format_string("%.9f", F.col(c).cast("double"))
    rows = ranked.where(F.col("rank") <= capacity)
    if "state" in ranked.columns:
        rows = rows.where(F.col("state") == state)
    refs = F.to_json(F.struct(*[number(c).alias(c) for c in sorted([*components, "score"])]))
    name = F.sha2(F.concat_ws("|", F.lit("promotion"), cohort, key, F.col("rank").cast("string")), 256)
    return rows.select(name.alias("event_id"), cohort, key, "rank", F.lit(state).alias("from_state"), F.lit(to).alias("to_state"), F.lit("RANKED_WITHIN_CAPACITY").alias("reason_code"), refs.alias("refs"))
