"""The whole way from rules over bars to a decision: opportunities, accepted trades, phases, robustness, null tests, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import contracts, gates, metrics, nulls, robustness, rules, trades
from tickloom.plans import tables as t
from tickloom.plans.bar_queries import RULES
from tickloom.plans.null_queries import scores_sql
from tickloom.plans.registry import query

CASH, COST, HOLD = 100_000.0, 0.0003, 3
COOLDOWN, MOST, OPEN, REPS = 0, 100, 3, 100
OFFSETS = (0, 2, 5, -1, -5)
CANDIDATES = {k: RULES[k] for k in ("breakout", "calm", "pullback")}
#: Every candidate and its neighbours, whose values are a tenth lower and higher.
VARIANTS = {f"{k}{suffix}": rules.nudged(r, factor) for k, r in CANDIDATES.items() for suffix, factor in (("", 1.0), ("~high", 1.1), ("~low", 0.9))}


def _sql(rule: dict) -> str:
    if "all" in rule or "any" in rule:
        return "(" + (" AND " if "all" in rule else " OR ").join(_sql(r) for r in rule.get("all", rule.get("any"))) + ")"
    op = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[rule["op"]]
    return f"coalesce({rule['indicator']} {op} {float(rule['value'])!r}::DOUBLE, false)"


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every variant could enter at each bar, in cents; a bar's hour since 1970 is the opportunity's number."""
    frame = t.feature_frame(spark, sf_dir)
    taken = rules.marks(frame, VARIANTS, ("symbol", "session_date", "slot", "bar_start"))
    rows = taken.join(trades.opportunities(t.bars(spark, sf_dir), HOLD, 10_000.0, COST), ["symbol", "session_date", "slot"])
    cents = lambda x: F.round(x * 100).cast("long")
    hour = lambda x: (F.col(x) * 3600).cast("long")
    return rows.select(
        "strategy_id", "symbol", "session_date", F.floor(F.unix_timestamp("bar_start") / 3600).alias("opportunity_id"), (hour("slot") + 3600).alias("signal_s"), hour("entry_slot").alias("entry_s"), (hour("exit_slot") + 3600).alias("exit_s"),
        "entered", cents(F.col("net_pnl")).alias("profit"), cents(F.col("quantity") * (F.col("exit_price") + F.col("entry_price")) * COST).alias("cost_cents"),
    )


_OPP = f"""SELECT r.strategy_id, r.symbol, r.session_date, CAST(floor(epoch(r.bar_start) / 3600) AS BIGINT) AS opportunity_id, CAST((slot + 1) * 3600 AS BIGINT) AS signal_s, CAST(entry_slot * 3600 AS BIGINT) AS entry_s, CAST((exit_slot + 1) * 3600 AS BIGINT) AS exit_s, entered,
        CAST(round(quantity * (exit_price * (1 - {COST}::DOUBLE) - entry_price * (1 + {COST}::DOUBLE)) * 100) AS BIGINT) AS profit, CAST(round(quantity * (exit_price + entry_price) * {COST}::DOUBLE * 100) AS BIGINT) AS cost_cents
    FROM ({" UNION ALL ".join(f"SELECT '{k}' AS strategy_id, symbol, session_date, slot, bar_start, {_sql(r)} AS entered FROM ({t.FEATURES})" for k, r in VARIANTS.items())}) r
    JOIN (SELECT *, floor(10000 / entry_price) AS quantity FROM (SELECT symbol, session_date, slot, lead(open) OVER w AS entry_price, lead(slot) OVER w AS entry_slot, coalesce(lead(close, {HOLD}) OVER w, last(close) OVER z) AS exit_price, coalesce(lead(slot, {HOLD}) OVER w, last(slot) OVER z) AS exit_slot FROM ({t.bars_sql()})
        WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot), z AS (PARTITION BY symbol, session_date ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE entry_price IS NOT NULL) USING (symbol, session_date, slot)"""


def accepted_trades(rows: DataFrame) -> DataFrame:
    """The entered opportunities that the trading rules accept: strategy_id, symbol, session_date, net_pnl and cost, in cents."""
    own = rows.where("entered").withColumn("entry_id", F.col("opportunity_id"))
    return nulls.accepted(own, COOLDOWN, MOST, OPEN).where("accepted").select("strategy_id", "symbol", "session_date", F.col("profit").alias("net_pnl"), F.col("cost_cents").alias("cost"))


_TRADES = f"""SELECT strategy_id, symbol, session_date, profit AS net_pnl, cost_cents AS cost FROM (
    WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy_id, session_date ORDER BY entry_s, symbol, opportunity_id) AS i FROM ({_OPP}) WHERE entered),
    f AS (SELECT strategy_id, session_date, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(y VARCHAR, x BIGINT)[]) AS taken, false AS ok, '' AS symbol, CAST(0 AS BIGINT) AS profit, CAST(0 AS BIGINT) AS cost_cents FROM (SELECT DISTINCT strategy_id, session_date FROM e)
        UNION ALL SELECT strategy_id, session_date, i, CASE WHEN ok THEN list_append(taken, {{'y': symbol, 'x': exit_s}}) ELSE taken END, ok, symbol, profit, cost_cents FROM
            (SELECT f.strategy_id, f.session_date, e.i, f.taken, e.symbol, e.exit_s, e.profit, e.cost_cents, len(f.taken) < {MOST} AND len(list_filter(f.taken, lambda k: k.x > e.entry_s)) < {OPEN} AND len(list_filter(f.taken, lambda k: k.y = e.symbol AND e.entry_s < k.x + {COOLDOWN})) = 0 AS ok
             FROM f JOIN e ON e.strategy_id = f.strategy_id AND e.session_date = f.session_date AND e.i = f.i + 1))
    SELECT * FROM f WHERE ok)"""
_DAYS = f"SELECT DISTINCT session_date FROM ({t.bars_sql()})"
_LABELS = f"""SELECT session_date, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'validation' ELSE 'final' END AS phase FROM (SELECT *,
        n * 7 // 10 + CASE WHEN (CASE WHEN n * 2 % 10 > n * 7 % 10 THEN 1 ELSE 0 END + CASE WHEN n % 10 > n * 7 % 10 THEN 1 ELSE 0 END) < n - n * 7 // 10 - n * 2 // 10 - n // 10 THEN 1 ELSE 0 END AS a,
        n * 2 // 10 + CASE WHEN (CASE WHEN n * 7 % 10 >= n * 2 % 10 THEN 1 ELSE 0 END + CASE WHEN n % 10 > n * 2 % 10 THEN 1 ELSE 0 END) < n - n * 7 // 10 - n * 2 // 10 - n // 10 THEN 1 ELSE 0 END AS b
        FROM (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i, count(*) OVER () AS n FROM ({_DAYS})))"""
_CENTS = CASH * 100
_PHASES = f"""SELECT strategy_id, phase, base_return, costly_return, trade_count, profit_factor, symbol_share, max_drawdown FROM
        (SELECT strategy_id, phase, sum(net_pnl) / {_CENTS}::DOUBLE AS base_return, (sum(net_pnl) - 0.5::DOUBLE * sum(cost)) / {_CENTS}::DOUBLE AS costly_return, count(*) AS trade_count, coalesce(sum(greatest(net_pnl, 0)) / nullif(sum(greatest(net_pnl, 0)) - sum(net_pnl), 0)::DOUBLE, 0) AS profit_factor FROM tr JOIN l USING (session_date) GROUP BY ALL)
    JOIN (SELECT strategy_id, phase, max(p) / nullif(sum(p), 0)::DOUBLE AS symbol_share FROM (SELECT strategy_id, phase, symbol, greatest(sum(net_pnl), 0) AS p FROM tr JOIN l USING (session_date) GROUP BY ALL) GROUP BY ALL) USING (strategy_id, phase)
    JOIN (SELECT strategy_id, phase, greatest(0, max(1 - equity / greatest({_CENTS}, peak))) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id, phase ORDER BY session_date) AS peak FROM
        (SELECT strategy_id, phase, session_date, {_CENTS}::DOUBLE + sum(pnl) OVER (PARTITION BY strategy_id, phase ORDER BY session_date) AS equity FROM (SELECT strategy_id, phase, session_date, sum(net_pnl) AS pnl FROM tr JOIN l USING (session_date) GROUP BY ALL))) GROUP BY ALL) USING (strategy_id, phase)"""
_BASE = f"WITH tr AS MATERIALIZED ({_TRADES}), l AS MATERIALIZED ({_LABELS}), p AS MATERIALIZED ({_PHASES})"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(opportunities, accepted trades, phases of the sessions, results by phase). The first two are written once, as every gate reads them."""
    rows = t.stored(opportunities(spark, sf_dir), "opportunities")
    own = t.stored(accepted_trades(rows), "trades")
    labels = metrics.chronological_split(t.bars(spark, sf_dir))
    return rows, own, labels, robustness.phase_results(own, labels, _CENTS)


_SHOWN = ("base_return", "costly_return", "profit_factor", "symbol_share", "max_drawdown")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 9) for c in _SHOWN})


@query(f"{_BASE} SELECT p.* REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _SHOWN)}) FROM p")
def k18_phase_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant's results in training, validation and final sessions."""
    return _shown(_parts(spark, sf_dir)[3])


@query(f"{_BASE} SELECT strategy_id FROM p WHERE phase = 'validation' AND {robustness.preselection(20, 0.5)}")
def k15_preselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose validation passes, for the few trades that a month of hourly bars gives."""
    results = _parts(spark, sf_dir)[3]
    return robustness.preselected(results, min_trades=20, drawdown=0.5)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate with what every hard gate reads, each from its own source."""
    rows, own, labels, results = _parts(spark, sf_dir)
    base = F.element_at(F.split("strategy_id", "~"), 1)
    candidate = base == F.col("strategy_id")
    chosen = robustness.preferred_phase(results.where(candidate), robustness.preselected(results))
    names = spark.createDataFrame([(k,) for k in CANDIDATES], "strategy_id string")
    windows = metrics.walk_forward(t.bars(spark, sf_dir), 10, 5, 3).where("role = 'evaluation'").select("window_id", "session_date")
    share = robustness.profitable_windows(own.where(candidate), windows, names)
    points = results.where((F.col("phase") == "validation") & ~candidate).select(base.alias("strategy_id"), F.col("base_return").alias("net_return"), "max_drawdown")
    near = robustness.neighborhood(points).select("strategy_id", F.col("stable").alias("neighborhood_stable"))
    returns = own.where(candidate).groupBy("strategy_id", "session_date").agg((F.sum("net_pnl") / _CENTS).alias("session_return"))
    starts = robustness.start_offsets(returns, OFFSETS).groupBy("strategy_id").agg(F.bool_and(F.col("net_return") > 0).alias("start_date_stable"))
    scores = nulls.null_scores(rows.where(candidate).join(labels.where("phase <> 'final'").select("session_date"), "session_date", "left_semi"), REPS, COOLDOWN, MOST, OPEN)
    seen = F.col("method") == nulls.OBSERVED
    null = robustness.null_verdict(scores.where(seen).select("strategy_id", "profit"), scores.where(~seen).withColumnRenamed("profit", "score")).select("strategy_id", "null_test_passed")
    out = chosen
    for part in (share, near, starts, null):
        out = out.join(part, "strategy_id", "left")
    return out


_NULL = scores_sql(f"SELECT o.* EXCLUDE (cost_cents) FROM ({_OPP}) o JOIN ({_LABELS}) l ON l.session_date = o.session_date AND l.phase <> 'final' WHERE strategy_id NOT LIKE '%~%'", REPS, COOLDOWN, MOST, OPEN)
_EVIDENCE = f"""{_BASE}, x AS MATERIALIZED ({_NULL}), s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM ({_DAYS})),
    wf AS (SELECT w, session_date FROM s, range(1000) r(w) WHERE w <= (n - 15) // 3 AND n >= 15 AND i >= w * 3 + 10 AND i < w * 3 + 15), sel AS (SELECT strategy_id FROM p WHERE phase = 'validation' AND {robustness.preselection()}),
    sr AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY session_date) AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM (SELECT strategy_id, session_date, sum(net_pnl) / {_CENTS}::DOUBLE AS r FROM tr WHERE strategy_id NOT LIKE '%~%' GROUP BY ALL)),
    st AS (SELECT strategy_id, bool_and(net > 0) AS start_date_stable FROM (SELECT strategy_id, o, list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY session_date)), lambda a, y: a * (1 + y)) - 1 AS net FROM sr, (VALUES {', '.join(f'({o})' for o in OFFSETS)}) v(o) WHERE (o >= 0 AND i > o) OR (o < 0 AND i <= n + o) GROUP BY ALL) GROUP BY 1),
    c AS (SELECT DISTINCT ON (strategy_id) * FROM (SELECT * FROM p WHERE strategy_id NOT LIKE '%~%' AND (phase = 'validation' OR phase = 'final' AND strategy_id IN (FROM sel))) ORDER BY strategy_id, phase)
    SELECT c.*, coalesce(w.n, 0) / (SELECT nullif(count(DISTINCT w), 0) FROM wf)::DOUBLE AS profitable_windows, g.neighborhood_stable, st.start_date_stable, nt.null_test_passed FROM c
    LEFT JOIN (SELECT strategy_id, count(*) AS n FROM (SELECT strategy_id, w FROM tr JOIN wf USING (session_date) GROUP BY ALL HAVING sum(net_pnl) > 0) GROUP BY 1) w USING (strategy_id)
    LEFT JOIN (SELECT split_part(strategy_id, '~', 1) AS strategy_id, avg(CASE WHEN base_return > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AND max(max_drawdown) <= 0.08 AS neighborhood_stable FROM p WHERE phase = 'validation' AND strategy_id LIKE '%~%' GROUP BY 1) g USING (strategy_id)
    LEFT JOIN st USING (strategy_id)
    LEFT JOIN (SELECT strategy_id, coalesce(bool_and(coalesce(o.profit > h.h, false)), false) AS null_test_passed FROM (SELECT strategy_id, profit FROM x WHERE method = '{nulls.OBSERVED}') o LEFT JOIN (SELECT strategy_id, method, quantile_disc(profit, 0.95) AS h FROM x WHERE method <> '{nulls.OBSERVED}' GROUP BY ALL) h USING (strategy_id) GROUP BY 1) nt USING (strategy_id)"""


@query(f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in (*_SHOWN, 'profitable_windows'))}) FROM ({_EVIDENCE})")
def k18_gate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates read: the preferred phase, evaluation windows, neighbours, start dates, and both null tests under the trading rules."""
    return _shown(evidence(spark, sf_dir)).withColumn("profitable_windows", F.round("profitable_windows", 9))


_ROWS = f"WITH e AS MATERIALIZED ({_EVIDENCE}) " + " UNION ALL ".join(f"SELECT strategy_id, {i} AS ordinal, '{code}' AS code, coalesce({p}, false) AS passed FROM e" for i, (code, p) in enumerate(gates.HARD_GATES, 1))


@query(_ROWS)
def l1_hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evaluate_gates(evidence(spark, sf_dir))


@query(f"SELECT strategy_id, CASE WHEN bool_and(passed) THEN 'PROMOTE' ELSE 'REJECT' END AS decision, coalesce(string_agg(code, ',' ORDER BY ordinal) FILTER (WHERE NOT passed), '') AS reasons FROM ({_ROWS}) GROUP BY strategy_id")
def l2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.decide(gates.evaluate_gates(evidence(spark, sf_dir)))


@query(f"SELECT o.strategy_id, o.profit, h.method, h.h AS threshold, o.profit > h.h AS passed FROM (SELECT * FROM ({_NULL}) WHERE method = '{nulls.OBSERVED}') o JOIN (SELECT strategy_id, method, quantile_disc(profit, 0.95) AS h FROM ({_NULL}) WHERE method <> '{nulls.OBSERVED}' GROUP BY ALL) h USING (strategy_id)")
def k14_null_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's profit against the 95th percentile of both null methods, nearest rank."""
    rows, _, labels, _ = _parts(spark, sf_dir)
    own = rows.where("strategy_id NOT LIKE '%~%'").join(labels.where("phase <> 'final'").select("session_date"), "session_date", "left_semi")
    scores = nulls.null_scores(own, REPS, COOLDOWN, MOST, OPEN)
    seen = F.col("method") == nulls.OBSERVED
    limits = metrics.nearest_rank(scores.where(~seen), "profit", 0.95, "strategy_id", "method")
    return scores.where(seen).select("strategy_id", "profit").join(limits, "strategy_id").withColumn("passed", F.col("profit") > F.col("threshold"))


_INPUTS = """SELECT v.strategy_id, v.base_return AS validation_return, f.base_return AS final_return, v.profit_factor AS validation_profit_factor, f.profit_factor AS final_profit_factor, v.max_drawdown AS validation_drawdown, f.max_drawdown AS final_drawdown, 1 AS copies
    FROM p v LEFT JOIN p f ON f.strategy_id = v.strategy_id AND f.phase = 'final' WHERE v.phase = 'validation'"""


def _broken(source: str, contract: str) -> str:
    return " UNION ALL ".join(f"SELECT strategy_id, '{name}' AS \"check\" FROM ({source}) WHERE NOT coalesce({rule}, false)" for name, rule in contracts.CONTRACTS[contract].items())


@query(f"{_BASE} {_broken(_INPUTS, 'ranking_input')}")
def v14_ranking_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each variant from the ranking, by its validation and final results."""
    results = _parts(spark, sf_dir)[3]
    names = ("base_return", "profit_factor", "max_drawdown")
    side = lambda phase: results.where(F.col("phase") == phase).select("strategy_id", *[F.col(c).alias(f"{phase}_{c.removeprefix('base_').removeprefix('max_')}") for c in names])
    return contracts.faults(contracts.ranking_inputs(side("validation").join(side("final"), "strategy_id", "left"), "strategy_id"), "ranking_input", "strategy_id")


_EVIDENCED = f"""WITH x AS MATERIALIZED ({_NULL}), m AS (SELECT strategy_id, method, count(*) AS n, quantile_disc(profit, 0.95) AS h FROM x WHERE method <> '{nulls.OBSERVED}' GROUP BY ALL)
    SELECT o.strategy_id, o.profit, count(DISTINCT m.method) AS methods, min(n) AS shortest, max(n) AS longest, max(h) AS threshold, bool_and(o.profit > h) AS passed, (SELECT count(*) FILTER (WHERE accepted < 0 OR rejected < 0) FROM x WHERE x.strategy_id = o.strategy_id) AS negative
    FROM (SELECT strategy_id, profit FROM x WHERE method = '{nulls.OBSERVED}') o JOIN m ON m.strategy_id = o.strategy_id GROUP BY ALL"""


@query(_EVIDENCED)
def v6_null_test_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null tests' evidence of each candidate, as its contract reads it; a test shows that the contract finds what is wrong."""
    rows, _, labels, _ = _parts(spark, sf_dir)
    own = rows.where("strategy_id NOT LIKE '%~%'").join(labels.where("phase <> 'final'").select("session_date"), "session_date", "left_semi")
    return contracts.null_evidence(nulls.null_scores(own, REPS, COOLDOWN, MOST, OPEN))
