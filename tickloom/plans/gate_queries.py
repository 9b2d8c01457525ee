"""Queries for gates, eligibility, entry risk and reconciliation, each with all of its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import contracts, evidence, gates, robustness
from tickloom.plans import tables as t
from tickloom.plans.registry import query, sql_of

_FORWARD = """SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY closed_trades DESC, strategy_id) <= 7 AS capacity_available FROM (
    SELECT event_type || '-' || (user_id % 10) AS strategy_id, event_type AS cohort, count(DISTINCT CAST(ts AS DATE)) AS completed_days, count(*) AS closed_trades, count(*) FILTER (WHERE event_id % 97 = 0 AND user_id % 3 = 0) AS unresolved_reconciliations,
        count(*) FILTER (WHERE hour(ts) = 23 AND event_id % 89 = 0) AS unresolved_overnight_incidents, CASE WHEN user_id % 10 = 7 THEN 'paper_active' ELSE 'paper_observing' END AS lifecycle_state,
        round(count(DISTINCT CAST(ts AS DATE)) / 30.0::DOUBLE, 9) AS data_completeness, round(count(*) FILTER (WHERE event_id % 25 <> 0) / count(*)::DOUBLE, 9) AS execution_quality, round(sum(value)::DOUBLE, 4) AS traded FROM events GROUP BY ALL)"""


def forward_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the paper phase: an event type and a tenth of the users."""
    from pyspark.sql import Window

    events, tenth = t.read(spark, sf_dir, "events"), F.col("user_id") % 10
    rows = events.groupBy(F.concat_ws("-", "event_type", tenth).alias("strategy_id"), F.col("event_type").alias("cohort"), tenth.alias("tenth")).agg(
        F.countDistinct(F.to_date("ts")).alias("completed_days"), F.count("*").alias("closed_trades"), F.count_if((F.col("event_id") % 97 == 0) & (F.col("user_id") % 3 == 0)).alias("unresolved_reconciliations"),
        F.count_if((F.hour("ts") == 23) & (F.col("event_id") % 89 == 0)).alias("unresolved_overnight_incidents"), F.round(F.avg((F.col("event_id") % 25 != 0).cast("double")), 9).alias("execution_quality"), F.round(F.sum("value"), 4).alias("traded"),
    )
    rows = rows.withColumn("lifecycle_state", F.when(F.col("tenth") == 7, "paper_active").otherwise("paper_observing")).withColumn("data_completeness", F.round(F.col("completed_days") / 30.0, 9))
    order = Window.partitionBy("cohort").orderBy(F.desc("closed_trades"), "strategy_id")
    return rows.drop("tenth").withColumn("capacity_available", F.row_number().over(order) <= 7)


_ELIGIBLE = f"WITH e AS MATERIALIZED ({_FORWARD}) " + " UNION ALL ".join(f"SELECT strategy_id, {i} AS ordinal, '{code}' AS code, coalesce({p}, false) AS passed FROM e" for i, (code, p) in enumerate(robustness.ELIGIBILITY, 1))


@query(f"SELECT strategy_id, CASE WHEN bool_and(passed) THEN 'PROMOTE' ELSE 'REJECT' END AS decision, coalesce(string_agg(code, ',' ORDER BY ordinal) FILTER (WHERE NOT passed), '') AS reasons FROM ({_ELIGIBLE}) GROUP BY strategy_id")
def l4_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.decide(gates.evaluate_gates(forward_evidence(spark, sf_dir), robustness.ELIGIBILITY))


_GATED = robustness.ELIGIBILITY


@query(f"""WITH e AS (SELECT * FROM ({_FORWARD}) WHERE {" AND ".join(f"coalesce({p}, false)" for _, p in _GATED)}),
    p AS (SELECT cohort, strategy_id, dense_rank() OVER (PARTITION BY cohort ORDER BY traded DESC) - 1 AS a, dense_rank() OVER (PARTITION BY cohort ORDER BY unresolved_reconciliations) - 1 AS b FROM e),
    n AS (SELECT *, max(a) OVER o AS ma, max(b) OVER o AS mb FROM p WINDOW o AS (PARTITION BY cohort)),
    s AS (SELECT cohort, strategy_id, round(0.7::DOUBLE * coalesce(1 - a / nullif(ma, 0)::DOUBLE, 1) + 0.3::DOUBLE * coalesce(1 - b / nullif(mb, 0)::DOUBLE, 1), 9) AS score FROM n)
    SELECT cohort, strategy_id, score, CAST(row_number() OVER (PARTITION BY cohort ORDER BY score DESC, strategy_id) AS INTEGER) AS rank FROM s""")
def l6_gate_then_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_then_rank(forward_evidence(spark, sf_dir), _GATED, {"traded": 0.7, "unresolved_reconciliations": 0.3}, frozenset(("unresolved_reconciliations",)), "cohort", "strategy_id")


_NUMBER = lambda c: f"printf('%.9f', {c}::DOUBLE)"


@query(f"""SELECT sha256('promotion|' || r.cohort || '|' || r.strategy_id || '|' || rank) AS event_id, r.cohort, r.strategy_id, rank, 'paper_observing' AS from_state, 'paper_active' AS to_state, 'RANKED_WITHIN_CAPACITY' AS reason_code,
    '{{"score":"' || {_NUMBER('score')} || '","traded":"' || {_NUMBER('traded')} || '","unresolved_reconciliations":"' || {_NUMBER('unresolved_reconciliations')} || '"}}' AS refs
    FROM ({sql_of("l6_gate_then_rank")}) r JOIN ({_FORWARD}) f ON f.strategy_id = r.strategy_id WHERE rank <= 2 AND f.lifecycle_state = 'paper_observing'""")
def j26_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion events of the first two of each cohort, with their scores as references."""
    forward = forward_evidence(spark, sf_dir)
    ranked = gates.gate_then_rank(forward, _GATED, {"traded": 0.7, "unresolved_reconciliations": 0.3}, frozenset(("unresolved_reconciliations",)), "cohort", "strategy_id")
    rows = ranked.join(forward.select("strategy_id", "traded", "unresolved_reconciliations", F.col("lifecycle_state").alias("state")), "strategy_id")
    return contracts.promotion_events(rows, 2, ["traded", "unresolved_reconciliations"])


# What an entry's context is in an order: expressions that Spark and DuckDB read alike.
_CONTEXT = """o_orderkey, o_orderkey % 53 <> 0 AS symbol_allowed, CAST(o_orderkey % 430 AS INT) AS minute, 5 AS open_minute, 420 AS close_minute, 15 AS closeout_minutes, CAST(o_orderkey % 71 AS INT) - 1 AS feed_age, 68 AS max_feed_age,
    CAST(o_custkey % 41 AS INT) - 1 AS clock_age, 38 AS max_clock_age, CASE WHEN o_orderkey % 31 = 0 THEN 'blocked' ELSE 'clean' END AS reconciliation_status, o_custkey % 37 = 0 AS storage_circuit_open, CAST(o_custkey % 29 AS INT) - 25 AS account_positions,
    CAST(o_orderkey % 23 AS INT) - 19 AS strategy_entries, o_orderpriority <> '5-LOW' OR o_custkey % 3 <> 0 AS strategy_enabled, CASE WHEN o_orderstatus = 'P' THEN 'sell' ELSE 'buy' END AS side, CAST(o_custkey % 19 AS INT) * 20000.0 - 10000.0 AS cash,
    o_orderkey % 17 <> 0 AS sizing_approved, CAST(o_custkey % 13 AS INT) AS sized_quantity, CAST(o_orderkey % 14 AS INT) AS quantity, o_totalprice AS required_cash, CAST(o_orderkey % 11 AS INT) AS daily_loss, 10 AS daily_loss_limit,
    CAST(o_custkey % 9 AS INT) AS account_loss, 8 AS account_loss_limit, CAST(o_orderkey % 8 AS INT) AS strategy_loss, 7 AS strategy_loss_limit, o_orderkey % 7 = 0 AS duplicate_intent, o_custkey % 6 = 0 AS conflicting_intent"""


@query(f"SELECT o_orderkey, CASE {' '.join(f"WHEN {c} THEN '{code}'" for code, c in robustness.ENTRY_REFUSALS)} ELSE 'ENTRY_RISK_APPROVED' END AS reason FROM (SELECT {_CONTEXT} FROM orders)")
def l12_entry_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.entry_risk(t.read(spark, sf_dir, "orders").selectExpr(*_expressions(_CONTEXT))).select("o_orderkey", "reason")


def _expressions(text: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, held = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


# Orders as the local book and the broker's, which differ by rules on their keys; a customer is an account, a clerk's digit a symbol.
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'submitted' ELSE 'partially_filled' END"
_LOCAL = f"SELECT o_custkey AS account, o_orderkey AS order_id, o_orderkey % 3 AS symbol, CASE WHEN o_orderkey % 4 = 0 THEN 'sell' ELSE 'buy' END AS side, o_orderkey % 9 + 1 AS quantity, 0 AS filled, {_STATUS} AS status FROM orders WHERE o_orderkey % 23 <> 0"
_BROKER = f"SELECT o_custkey AS account, o_orderkey AS order_id, o_orderkey % 3 AS symbol, CASE WHEN o_orderkey % 4 = 0 THEN 'sell' ELSE 'buy' END AS side, o_orderkey % 9 + 1 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS quantity, 0 AS filled, CASE WHEN o_orderkey % 11 = 0 THEN 'filled' WHEN o_orderkey % 37 = 0 THEN 'cancelled' ELSE {_STATUS} END AS status FROM orders WHERE o_orderkey % 19 <> 0"
_HELD = "SELECT account, symbol, CAST(sum(quantity) AS BIGINT) AS held FROM ({}) WHERE side = 'buy' AND status = 'filled' GROUP BY account, symbol"
_BROKER_HELD = f"SELECT account, symbol, CAST(sum(quantity) AS BIGINT) AS held FROM (SELECT account, symbol, quantity FROM ({_LOCAL}) WHERE side = 'buy' AND status = 'filled' UNION ALL SELECT account, symbol, quantity FROM ({_LOCAL}) WHERE side = 'buy' AND status <> 'filled' AND order_id % 19 = 0 UNION ALL SELECT account, symbol, CAST(1 AS BIGINT) FROM ({_BROKER}) WHERE order_id % 97 = 0) GROUP BY account, symbol"


@query(f"""WITH l AS ({_LOCAL}), b AS ({_BROKER}), lp AS ({_HELD.format(_LOCAL)}), bp AS ({_BROKER_HELD}),
    o AS (SELECT coalesce(l.account, b.account) AS account, coalesce(l.symbol, b.symbol) AS symbol, CASE WHEN l.order_id IS NULL THEN 'UNKNOWN_BROKER_ORDER' WHEN b.order_id IS NOT NULL AND (l.symbol <> b.symbol OR l.side <> b.side OR l.quantity <> b.quantity) THEN 'ORDER_IDENTITY_MISMATCH'
            WHEN b.order_id IS NOT NULL AND l.status <> b.status THEN CASE WHEN l.status <> 'filled' AND b.status = 'filled' THEN 'LOCAL_ORDER_STATUS_STALE' ELSE 'ORDER_STATUS_MISMATCH' END
            WHEN b.order_id IS NULL AND l.status <> 'filled' THEN CASE WHEN l.side = 'buy' AND bp.held = coalesce(lp.held, 0) + l.quantity - l.filled THEN 'PENDING_ENTRY_FILLED_AT_BROKER' ELSE 'LOCAL_OPEN_ORDER_MISSING_AT_BROKER' END END AS code
        FROM l FULL JOIN b USING (account, order_id) LEFT JOIN lp ON lp.account = coalesce(l.account, b.account) AND lp.symbol = coalesce(l.symbol, b.symbol) LEFT JOIN bp ON bp.account = coalesce(l.account, b.account) AND bp.symbol = coalesce(l.symbol, b.symbol)),
    p AS (SELECT coalesce(lp.account, bp.account) AS account, CASE WHEN lp.held IS NULL THEN CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.account = bp.account AND o.symbol = bp.symbol AND o.code = 'PENDING_ENTRY_FILLED_AT_BROKER') THEN 'BROKER_POSITION_MISSING_LOCALLY' END
            WHEN bp.held IS NULL THEN 'LOCAL_POSITION_MISSING_AT_BROKER' WHEN lp.held <> bp.held THEN 'POSITION_QUANTITY_MISMATCH' END AS code FROM lp FULL JOIN bp ON lp.account = bp.account AND lp.symbol = bp.symbol),
    c AS (SELECT DISTINCT account, code, code IN ('LOCAL_ORDER_STATUS_STALE', 'PENDING_ENTRY_FILLED_AT_BROKER') AS soft FROM (SELECT account, code FROM o UNION ALL SELECT account, code FROM p) WHERE code IS NOT NULL),
    s AS (SELECT account, coalesce(bool_or(NOT soft), false) AS hard FROM c GROUP BY 1)
    SELECT a.account, CASE WHEN s.hard THEN 'blocked' WHEN s.account IS NOT NULL THEN 'recoverable' ELSE 'clean' END AS status, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM c WHERE c.account = a.account AND (NOT s.hard OR NOT c.soft)), '') AS codes
    FROM (SELECT DISTINCT account FROM l) a LEFT JOIN s ON s.account = a.account""")
def j5_reconciliation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "orders")
    local, broker, held, broker_held = (spark.sql(x.replace("FROM orders", "FROM {orders}"), orders=rows) for x in (_LOCAL, _BROKER, _HELD.format(_LOCAL), _BROKER_HELD))
    orders = evidence.order_discrepancies(local, broker, held, broker_held)
    positions = evidence.position_discrepancies(held, broker_held, orders.where("code = 'PENDING_ENTRY_FILLED_AT_BROKER'"))
    return evidence.reconciliation_status(local, orders.unionByName(positions))
