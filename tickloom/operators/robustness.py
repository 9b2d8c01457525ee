"""Stability of candidates and assembly of gate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.metrics import max_drawdown, nearest_rank

# The codes of the eligibility gates, in order, with their thresholds.
ELIGIBILITY = (
    ("MIN_COMPLETED_PAPER_DAYS", "completed_days >= 30"),
    ("MIN_BROKER_CONFIRMED_CLOSED_TRADES", "closed_trades >= 50"),
    ("NO_UNRESOLVED_RECONCILIATION", "unresolved_reconciliations = 0"),
    ("NO_UNRESOLVED_OVERNIGHT_RISK", "unresolved_overnight_incidents = 0"),
    ("OBSERVING_LIFECYCLE_REQUIRED", "lifecycle_state = 'paper_observing'"),
    ("MIN_DATA_COMPLETENESS", "data_completeness >= 0.99"),
    ("MIN_EXECUTION_QUALITY", "execution_quality >= 0.95"),
    ("RANKED_CAPACITY_AVAILABLE", "capacity_available"),
)
# The reasons that keep an entry out, in order, each with the condition that it stands for.
ENTRY_REFUSALS = (
    ("SYMBOL_NOT_ALLOWED", "NOT symbol_allowed"),
    ("OUTSIDE_REGULAR_HOURS", "minute < open_minute OR minute >= close_minute"),
    ("CLOSEOUT_BUFFER_ACTIVE", "minute >= close_minute - closeout_minutes"),
    ("FEED_STALE", "feed_age < 0 OR feed_age > max_feed_age"),
    ("BROKER_CLOCK_STALE", "clock_age < 0 OR clock_age > max_clock_age"),
    ("RECONCILIATION_NOT_CLEAN", "reconciliation_status <> 'clean'"),
    ("STORAGE_CIRCUIT_OPEN", "storage_circuit_open"),
    ("ACCOUNT_POSITION_LIMIT", "account_positions >= 3"),
    ("STRATEGY_ENTRY_LIMIT", "strategy_entries >= 3"),
    ("STRATEGY_NOT_ENABLED", "NOT strategy_enabled"),
    ("LONG_ONLY_ENTRY_REQUIRED", "side <> 'buy'"),
    ("NEGATIVE_CASH", "cash < 0"),
    ("NO_FEASIBLE_INTEGER_POSITION", "NOT sizing_approved OR sized_quantity < 1"),
    ("QUANTITY_EXCEEDS_CONSERVATIVE_SIZE", "quantity > sized_quantity"),
    ("MARGIN_OR_LEVERAGE_REQUIRED", "required_cash > cash"),
    ("DAILY_LOSS_LIMIT_BREACHED", "daily_loss >= daily_loss_limit"),
    ("ACCOUNT_LOSS_LIMIT_BREACHED", "account_loss >= account_loss_limit"),
    ("STRATEGY_LOSS_LIMIT_BREACHED", "strategy_loss >= strategy_loss_limit"),
    ("DUPLICATE_INTENT", "duplicate_intent"),
    ("CONFLICTING_INTENT", "conflicting_intent"),
)
ENTRY_APPROVED = "ENTRY_RISK_APPROVED"


def entry_risk(contexts: DataFrame) -> DataFrame:
    """contexts with `reason`: the first refusal, in order, whose condition holds, or ENTRY_APPROVED. A condition that is null refuses."""
    refused = [F.when(F.coalesce(F.expr(c), F.lit(True)), code) for code, c in ENTRY_REFUSALS]
    return contexts.withColumn("reason", F.coalesce(*refused, F.lit(ENTRY_APPROVED)))


def neighborhood(points: DataFrame, key: str = "strategy_id", share: float = 0.6, drawdown: float = 0.08) -> DataFrame:
    """Whether enough neighbouring points of each candidate are profitable and none falls too far. Columns: key, net_return, max_drawdown."""
    stable = (F.avg((F.col("net_return") > 0).cast("double")) >= share) & (F.max("max_drawdown") <= drawdown)
    return points.groupBy(key).agg(F.count("*").alias("points"), F.avg((F.col("net_return") > 0).cast("double")).alias("profitable_share"), F.max("max_drawdown").alias("worst_drawdown"), stable.alias("stable"))


def start_offsets(returns: DataFrame, offsets: tuple[int, ...], key: str = "strategy_id") -> DataFrame:
    """Compounded return of each candidate without its first sessions (offset > 0) or its last ones (offset < 0)."""
    w = Window.partitionBy(key)
    rows = returns.select(key, "session_date", "session_return", F.row_number().over(w.orderBy("session_date")).alias("i"), F.count("*").over(w).alias("n"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).where(((F.col("offset") >= 0) & (F.col("i") > F.col("offset"))) | ((F.col("offset") < 0) & (F.col("i") <= F.col("n") + F.col("offset"))))
    path = F.transform(F.array_sort(F.collect_list(F.struct("session_date", "session_return"))), lambda x: x["session_return"])
    return rows.groupBy(key, "offset").agg(path.alias("r")).select(key, "offset", (F.aggregate("r", F.lit(1.0), lambda a, r: a * (1.0 + r)) - 1.0).alias("net_return"))


def first_neighbours(ids: DataFrame, n: int = 5, key: str = "variant_rank", group: str = "hypothesis_id") -> DataFrame:
    """The first n other variants of each variant's hypothesis: among its first n + 1 variants, those that are not itself."""
    first = ids.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_r") <= n + 1).select(group, F.col(key).alias("neighbour"))
    pairs = ids.select(group, key).join(first, group).where(F.col(key) != F.col("neighbour"))
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(group, key).orderBy("neighbour"))).where(F.col("_r") <= n).drop("_r")


def preselection(min_trades: int = 100, drawdown: float = 0.08, factor: float = 1.15) -> str:
    """What a candidate's validation must show before the final phase is opened to it."""
    return f"base_return > 0 AND costly_return > 0 AND trade_count >= {min_trades} AND max_drawdown <= {drawdown} AND profit_factor >= {factor}"


def phase_results(trades: DataFrame, labels: DataFrame, cash: float) -> DataFrame:
    """(strategy_id, phase, base_return, costly_return, trade_count, profit_factor, max_drawdown, symbol_share) of the trades of each phase.

    trades: strategy_id, symbol, session_date, net_pnl, cost. Costs half as high again are taken off for costly_return; the drawdown is that of
    the phase's own equity, session by session; symbol_share is null without a gain.
    """
    rows = trades.join(labels.select("session_date", "phase"), "session_date")
    net, gain = F.sum("net_pnl"), F.sum(F.greatest("net_pnl", F.lit(0)))
    own = rows.groupBy("strategy_id", "phase").agg((net / cash).alias("base_return"), ((net - 0.5 * F.sum("cost")) / cash).alias("costly_return"), F.count("*").alias("trade_count"), F.coalesce(F.try_divide(gain, F.nullif(gain - net, F.lit(0))), F.lit(0.0)).alias("profit_factor"))
    key = F.concat_ws("|", "strategy_id", "phase").alias("key")
    daily = rows.groupBy("strategy_id", "phase", "session_date").agg(net.alias("pnl")).select(key, "session_date", "pnl")
    equity = daily.select("key", "session_date", F.col("session_date").alias("event_time"), (F.lit(cash) + F.sum("pnl").over(Window.partitionBy("key").orderBy("session_date"))).cast("double").alias("equity"))
    falls = max_drawdown(equity, cash, "key")
    part = rows.groupBy("strategy_id", "phase", "symbol").agg(F.greatest(net, F.lit(0)).alias("p")).groupBy("strategy_id", "phase").agg(F.try_divide(F.max("p"), F.nullif(F.sum("p"), F.lit(0))).alias("symbol_share"))
    return own.join(part, ["strategy_id", "phase"]).select("*", key).join(falls, "key").drop("key")


def preselected(results: DataFrame, **limits: float) -> DataFrame:
    """(strategy_id) of the candidates whose validation opens the final phase to them. limits: those of preselection."""
    return results.where((F.col("phase") == "validation") & F.expr(preselection(**limits))).select("strategy_id")


def preferred_phase(results: DataFrame, survivors: DataFrame) -> DataFrame:
    """One row for each candidate: its final phase if it was preselected and has one, else its validation."""
    own = results.join(survivors.withColumn("_s", F.lit(True)), "strategy_id", "left").where((F.col("phase") == "validation") | ((F.col("phase") == "final") & F.col("_s")))
    return own.groupBy("strategy_id").agg(F.min_by(F.struct(*results.drop("strategy_id").columns), "phase").alias("r")).select("strategy_id", "r.*")  # "final" sorts first


def profitable_windows(trades: DataFrame, windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(strategy_id, profitable_windows): the share of the evaluation windows in which each candidate earned; a window without a trade earned
    nothing. windows: one row for each window and evaluation session, a few for each session."""
    many = windows.select("window_id").distinct()
    earned = trades.join(windows, "session_date").groupBy("strategy_id", "window_id").agg((F.sum("net_pnl") > 0).alias("ok")).where("ok").groupBy("strategy_id").agg(F.count("*").alias("n"))
    total = many.agg(F.count("*").alias("total"))
    rows = candidates.select("strategy_id").distinct().join(earned, "strategy_id", "left").join(F.broadcast(total))  # one row
    return rows.select("strategy_id", F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")).alias("profitable_windows"))


def null_verdict(observed: DataFrame, scores: DataFrame, key: str = "strategy_id", p: float = 0.95) -> DataFrame:
    """Whether each candidate's profit is above the nearest-rank percentile of every null method's scores (key, method, score)."""
    limits = nearest_rank(scores, "score", p, key, "method")
    return observed.join(limits, key, "left").groupBy(key).agg(F.coalesce(F.bool_and(F.coalesce(F.col("profit") > F.col("threshold"), F.lit(False))), F.lit(False)).alias("null_test_passed"), F.max("threshold").alias("threshold"))


def sealed_view(frame: DataFrame, labels: DataFrame, phase: str, survivors: DataFrame | None, key: str = "strategy_id") -> DataFrame:
    """Rows of a phase's sessions; the final phase is shown for sealed survivors only."""
    own = frame.join(F.broadcast(labels.where(F.col("phase") == phase).select("session_date")), "session_date", "left_semi")
    if phase != "final":
        return own
    if survivors is None:
        raise ValueError("the final phase needs the table of sealed survivors")
    return own.join(survivors.select(key), key, "left_semi")


def selection_hash(survivors: DataFrame, key: str, content: str) -> DataFrame:
    """One hash over the sorted survivors with their content hashes (a survivor list is short)."""
    return survivors.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, content))), "|"), 256).alias("selection_sha256"), F.count("*").alias("survivors"))


PHASES = ("train", "validation", "final")


def label_faults(labels: DataFrame) -> DataFrame:
    """(session_date, phase, code) of a given table of labels: UNKNOWN_PHASE; SESSION_REPEATED and PHASES_OVERLAP, where a session has a label
    twice or several; OUT_OF_ORDER, where a later phase has begun before. A null session or phase is unknown."""
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = labels.groupBy("session_date", "phase").agg(F.count("*").alias("n")).withColumn("place", F.when(F.col("session_date").isNull() | F.col("phase").isNull(), 0).otherwise(place))
    begins = rows.where("place > 0").agg(*[F.min(F.when(F.col("place") > i, F.col("session_date"))).alias(f"_b{i}") for i in (1, 2)])
    own = rows.join(F.broadcast(begins)).withColumn("_phases", F.count("*").over(Window.partitionBy("session_date")))  # one row
    late = ((F.col("place") == 1) & (F.col("session_date") > F.col("_b1"))) | ((F.col("place") == 2) & (F.col("session_date") > F.col("_b2")))
    codes = F.array_compact(F.array(F.when(F.col("place") == 0, "UNKNOWN_PHASE"), F.when(F.col("n") > 1, "SESSION_REPEATED"), F.when((F.col("place") > 0) & (F.col("_phases") > 1), "PHASES_OVERLAP"), F.when(late, "OUT_OF_ORDER")))
    return own.select("session_date", "phase", F.explode(codes).alias("code"))
