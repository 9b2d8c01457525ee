"""Assertions over whole tables: each query gives the rows or keys that break a rule, or the counts that a report needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import evidence, metrics, robustness, rules, trades
from tickloom.operators.contracts import CONTRACTS
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.trade_queries import CASH


def broken_sql(source: str, rules: dict[str, str], key: str) -> str:
    """The SQL of evidence.offending: a row for each key and rule that does not hold."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS \"check\" FROM ({source}) WHERE NOT coalesce({rule}, false)" for name, rule in rules.items())


def broken(rows: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    return evidence.offending(rows, rules, key)


# Orders as intents: a price only where the priority asks for one; a line is a fill.
_INTENTS = """o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'market' ELSE 'limit' END AS order_type, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS limit_price, o_orderkey % 9 + 1 AS requested, o_orderkey % 10 AS filled, o_orderstatus"""
INTENT_RULES = CONTRACTS["order_intent"]


@query(broken_sql(f"SELECT {_INTENTS} FROM orders", INTENT_RULES, "o_orderkey"))
def v2_order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(t.read(spark, sf_dir, "orders").selectExpr(*_split(_INTENTS)), INTENT_RULES, "o_orderkey")


def _split(text: str) -> list[str]:
    from tickloom.plans.gate_queries import _expressions

    return _expressions(text)


SCENARIO_RULES = {"three_scenarios": "scenarios = 3", "enough_lines": "lines % 3 = 0", "finite": "paid IS NOT NULL AND paid < 1e300", "all_symbols": "symbols = 3"}


@query(broken_sql(f"SELECT l_suppkey, count(*) AS lines, count(DISTINCT s) AS scenarios, count(DISTINCT l_returnflag) AS symbols, sum(l_extendedprice * (1 + s / 10000.0::DOUBLE)) AS paid FROM lineitem, (VALUES (1), (3), (7)) v(s) WHERE l_linenumber <= 2 OR l_suppkey % 2 = 0 OR s <> 7 GROUP BY 1", SCENARIO_RULES, "l_suppkey"))
def v5_phase_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.with_scenarios(t.read(spark, sf_dir, "lineitem")).where("l_linenumber <= 2 OR l_suppkey % 2 = 0 OR scenario <> 'stress'")
    own = rows.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.countDistinct("scenario").alias("scenarios"), F.countDistinct("l_returnflag").alias("symbols"), F.sum(F.col("l_extendedprice") * (1 + F.col("impact_bps") / 10000)).alias("paid"))
    return broken(own, SCENARIO_RULES, "l_suppkey")


# Six score sequences of a strategy agree in length, and the verdict agrees with their thresholds.
NULL_RULES = {"six_sequences": "sequences = 6", "one_length": "shortest = longest", "verdict_agrees": "passed = (profit > threshold)"}


@query(broken_sql("""SELECT l_suppkey, count(*) AS sequences, min(n) AS shortest, max(n) AS longest, max(threshold) AS threshold, sum(total) AS profit, sum(total) > max(threshold) + 1000 AS passed
    FROM (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS threshold, max(l_discount * l_extendedprice) AS total FROM lineitem GROUP BY ALL) GROUP BY 1""", NULL_RULES, "l_suppkey"))
def v6_null_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("threshold"), F.max(F.col("l_discount") * F.col("l_extendedprice")).alias("total"))
    own = own.groupBy("l_suppkey").agg(F.count("*").alias("sequences"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.max("threshold").alias("threshold"), F.sum("total").alias("profit"))
    return broken(own.withColumn("passed", F.col("profit") > F.col("threshold") + 1000), NULL_RULES, "l_suppkey")


_RUNS = "o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'clean' WHEN 'P' THEN 'recoverable' ELSE 'blocked' END AS status, o_orderkey % 5 <> 0 AND o_orderstatus = 'F' OR o_orderkey % 41 = 0 AS entries_allowed, o_orderkey % 43 <> 0 AS exits_allowed"
PERMISSION_RULES = CONTRACTS["permissions"]


@query(broken_sql(f"SELECT {_RUNS} FROM orders", PERMISSION_RULES, "o_orderkey"))
def v7_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(t.read(spark, sf_dir, "orders").selectExpr(*_split(_RUNS)), PERMISSION_RULES, "o_orderkey")


KEY_RULES = {"symbol_named": "length(symbol) > 0 AND symbol <> 'error'", "session_expected": "expected"}


@query(broken_sql(f"SELECT symbol || '|' || CAST(k.session_date AS VARCHAR) AS group_key, symbol, dayofweek(k.session_date) NOT IN (0, 6) AS expected FROM (SELECT DISTINCT symbol, session_date FROM ({t.TICKS})) k", KEY_RULES, "group_key"))
def v8_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t.ticks(spark, sf_dir).select("symbol", "session_date").distinct()
    return broken(keys.select(F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("group_key"), "symbol", (~F.dayofweek("session_date").isin(1, 7)).alias("expected")), KEY_RULES, "group_key")


RESULT_RULES = CONTRACTS["result_files"]
_RESULT = "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'running' END"


@query(broken_sql(f"SELECT o_orderkey, {_RESULT} AS status, coalesce(n, 0) AS files FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", RESULT_RULES, "o_orderkey"))
def v9_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RESULT).alias("status")).join(files, "o_orderkey", "left")
    return broken(rows.select("o_orderkey", "status", F.coalesce("n", F.lit(0)).alias("files")), RESULT_RULES, "o_orderkey")


TRADE_RULES = CONTRACTS["trade"]
_TRADE = "l_orderkey, l_quantity AS quantity, l_extendedprice / l_quantity AS entry_price, l_extendedprice * (1 - l_discount) / l_quantity AS exit_price, o_orderdate AS entry_time, l_shipdate AS exit_time, l_tax * l_extendedprice AS cost_paid, l_discount * l_extendedprice / CASE WHEN l_discount > 0 THEN 1 END AS net_pnl"


@query("SELECT \"check\", count(*) AS trades FROM (" + broken_sql(f"SELECT {_TRADE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey", TRADE_RULES, "l_orderkey") + ") GROUP BY 1")
def v10_trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as trades; one without a discount has no profit that could be told."""
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return broken(rows.selectExpr(*_split(_TRADE)), TRADE_RULES, "l_orderkey").groupBy("check").agg(F.count("*").alias("trades"))


RANGE_RULES = CONTRACTS["range"] | {"whole_day": "last_ts >= first_ts + INTERVAL 1 HOUR"}


@query(broken_sql("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id, CAST(ts AS DATE)", RANGE_RULES, "user_id"))
def v11_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return broken(rows, RANGE_RULES, "user_id")


@query("SELECT event_id, user_id, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before = event_type")
def v12_unchanged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.read(spark, sf_dir, "events").withColumn("before", before).where("before = event_type").select("event_id", "user_id", F.col("event_type").alias("state"))


@query("""WITH d AS (SELECT ps AS id, count(*) AS n FROM (SELECT s_nationkey AS ps FROM supplier) GROUP BY 1), u AS (SELECT c_nationkey AS id, count(*) AS m FROM customer GROUP BY 1)
    SELECT coalesce(d.id, u.id) AS id, CASE WHEN d.id IS NULL THEN 'UNKNOWN' WHEN u.id IS NULL THEN 'UNUSED' WHEN n > 1 THEN 'NOT_UNIQUE' ELSE 'COUNT_DIFFERS' END AS issue, coalesce(n, 0) AS declared, coalesce(m, 0) AS used FROM d FULL JOIN u ON d.id = u.id WHERE coalesce(n, 0) <> 1 OR coalesce(m, 0) <> 1""")
def v13_declared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as declared ids against those that customers use."""
    return evidence.id_faults(t.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")), t.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")))


RANK_RULES = {"positive_return": "pnl > 0", "profit_factor_at_least_one": "gain >= loss", "unique": "n = days"}


@query(broken_sql("SELECT l_suppkey, sum((l_discount - 0.05) * l_extendedprice) AS pnl, sum(CASE WHEN l_discount > 0.05 THEN (l_discount - 0.05) * l_extendedprice ELSE 0 END) AS gain, sum(CASE WHEN l_discount < 0.05 THEN (0.05 - l_discount) * l_extendedprice ELSE 0 END) AS loss, count(*) AS n, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1", RANK_RULES, "l_suppkey"))
def v14_ranking_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.col("l_discount") - 0.05
    rows = t.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(edge * F.col("l_extendedprice")).alias("pnl"), F.sum(F.when(edge > 0, edge * F.col("l_extendedprice")).otherwise(0)).alias("gain"), F.sum(F.when(edge < 0, -edge * F.col("l_extendedprice")).otherwise(0)).alias("loss"),
        F.count("*").alias("n"), F.countDistinct("l_shipdate").alias("days"),
    )
    return broken(rows, RANK_RULES, "l_suppkey")


@query("""SELECT user_id, enabled, sessions, clean, enabled BETWEEN 1 AND 20 AND clean AND sessions > 0 AS ready FROM (SELECT user_id, count(DISTINCT event_type) FILTER (WHERE value > 100) AS enabled, count(DISTINCT CAST(ts AS DATE)) AS sessions, count(*) FILTER (WHERE event_type = 'error' AND value > 450) = 0 AS clean FROM events GROUP BY 1)""")
def v15_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.when(F.col("value") > 100, F.col("event_type"))).alias("enabled"), F.countDistinct(F.to_date("ts")).alias("sessions"), (F.count_if((F.col("event_type") == "error") & (F.col("value") > 450)) == 0).alias("clean"))
    return rows.withColumn("ready", F.col("enabled").between(1, 20) & F.col("clean") & (F.col("sessions") > 0))


@query("SELECT count(DISTINCT (event_type, user_id % 7)) AS pairs, count(*) FILTER (WHERE event_type IS NULL OR event_type = '') AS empty, count(DISTINCT (event_type, user_id % 7)) = 1 AS single FROM events")
def c6_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.countDistinct("event_type", F.col("user_id") % 7)
    return t.read(spark, sf_dir, "events").agg(pairs.alias("pairs"), F.count_if(F.col("event_type").isNull() | (F.col("event_type") == "")).alias("empty"), (pairs == 1).alias("single"))


@query("SELECT o_orderkey, datediff('day', CAST(last AS DATE), CAST(o_orderdate AS DATE) + 60)::BIGINT AS days_late FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) + 60 < CAST(last AS DATE)")
def c8_ingested_before_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    ingested = F.date_add(F.to_date("o_orderdate"), 60)
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(last, "o_orderkey").where(ingested < F.col("last"))
    return rows.select("o_orderkey", F.datediff(ingested, "last").cast("long").alias("days_late"))


@query(f"""WITH b AS (SELECT symbol, session_date, slot FROM ({t.bars_sql()}) WHERE slot >= 2), g AS (SELECT symbol, session_date, slot FROM (SELECT DISTINCT symbol FROM b), ({t.GRID}) WHERE slot < 22)
    SELECT coalesce(b.symbol, g.symbol) AS symbol, CASE WHEN g.slot IS NULL THEN 'OUTSIDE_SESSION' ELSE 'MISSING' END AS code, count(*) AS bars FROM b FULL JOIN g ON b.symbol = g.symbol AND b.session_date = g.session_date AND b.slot = g.slot WHERE b.slot IS NULL OR g.slot IS NULL GROUP BY ALL""")
def c9_exact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir).where("slot >= 2").select("symbol", "session_date", "slot", F.lit(1).alias("b"))
    symbols = F.broadcast(bars.agg(F.collect_set("symbol").alias("s")))  # one row, of the symbols
    grid = t.grid(spark).where("slot < 22").select("session_date", "slot").crossJoin(symbols).select("session_date", "slot", F.explode("s").alias("symbol"), F.lit(1).alias("g"))
    both = bars.join(grid, ["symbol", "session_date", "slot"], "full").where("b IS NULL OR g IS NULL")
    return both.groupBy("symbol", F.when(F.col("g").isNull(), "OUTSIDE_SESSION").otherwise("MISSING").alias("code")).agg(F.count("*").alias("bars"))


@query(f"SELECT symbol, CAST(session_date AS VARCHAR) AS session, slot, 'OUTSIDE_SESSION' AS code FROM ({t.bars_sql()}) WHERE slot < 2 OR slot >= 22")
def e2_outside_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = t.grid(spark).where("slot BETWEEN 2 AND 21").select("session_date", "slot")
    rows = t.bars(spark, sf_dir).join(F.broadcast(inside), ["session_date", "slot"], "left_anti")  # the grid of a calendar, 22 rows a day
    return rows.select("symbol", F.col("session_date").cast("string").alias("session"), "slot", F.lit("OUTSIDE_SESSION").alias("code"))


_COST = 0.0003


@query(f"""WITH b AS (SELECT symbol, session_date, slot, open, close, lead(open) OVER w AS entry_price, lead(close, 3) OVER w AS later, last(close) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_end FROM ({t.bars_sql()}) WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot))
    SELECT symbol, CAST(session_date AS VARCHAR) AS session, slot, entry_price, coalesce(later, at_end) AS exit_price, CAST(floor(10000 / entry_price) AS BIGINT) AS quantity,
        round(floor(10000 / entry_price) * (coalesce(later, at_end) * (1 - {_COST}::DOUBLE) - entry_price * (1 + {_COST}::DOUBLE)), 2) AS net_pnl FROM b WHERE entry_price IS NOT NULL""")
def f10_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.opportunities(t.bars(spark, sf_dir), hold=3, budget=10000.0, cost=_COST).select("symbol", F.col("session_date").cast("string").alias("session"), "slot", "entry_price", "exit_price", "quantity", F.round("net_pnl", 2).alias("net_pnl"))


@query(f"""SELECT symbol, round(avg(volume * close / ({CASH} + volume * close)), 9) AS exposure, round(sum(volume * (open + close)) / {CASH}, 6) AS turnover, round(sum(0.0003::DOUBLE * volume * (open + close)), 4) AS cost_paid, round(sum(volume * (close - open)) / {CASH}, 9) AS net_return FROM ({t.bars_sql()}) GROUP BY 1""")
def h5_exposure_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    gross = F.col("volume") * F.col("close")
    marks = bars.select("symbol", gross.alias("gross_exposure"), (gross + CASH).alias("equity"))
    own = bars.select("symbol", F.col("volume").alias("quantity"), F.col("open").alias("entry_price"), F.col("close").alias("exit_price"), (0.0003 * F.col("volume") * (F.col("open") + F.col("close"))).alias("cost_paid"), (F.col("volume") * (F.col("close") - F.col("open"))).alias("net_pnl"))
    out = metrics.exposure_turnover(marks, own, CASH, "symbol")
    return out.select("symbol", F.round("exposure", 9).alias("exposure"), F.round("turnover", 6).alias("turnover"), F.round("cost_paid", 4).alias("cost_paid"), F.round("net_return", 9).alias("net_return"))


@query("SELECT o_custkey, o_orderkey FROM orders p WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = p.o_custkey AND d.o_orderstatus = 'O' AND d.o_orderdate <= p.o_orderdate)")
def j10_promotions_without_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    first = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("decided"))
    return orders.where("o_orderstatus = 'F'").join(first, "o_custkey", "left").where("decided IS NULL OR decided > o_orderdate").select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey AS id, 'not_ranked' AS issue FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL
    SELECT DISTINCT o_custkey, 'ranked_not_passed' FROM orders WHERE o_totalprice > 200000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def j21_ranked_equals_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = t.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    ranked = t.read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).distinct()
    return passed.join(ranked, "id", "left_anti").select("id", F.lit("not_ranked").alias("issue")).unionByName(ranked.join(passed, "id", "left_anti").select("id", F.lit("ranked_not_passed").alias("issue")))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS sequence_no, CAST(CAST(ts AS DATE) AS VARCHAR) AS session FROM events")
def j24_log_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return t.read(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(order).alias("sequence_no"), day.cast("string").alias("session"))


@query("""SELECT action, count(*) AS updates FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'rejected_unknown' WHEN l_returnflag = before THEN 'ignored_identical' ELSE 'applied' END AS action
    FROM (SELECT l_orderkey + (l_linenumber % 7 // 6) AS k, l_returnflag, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem) LEFT JOIN orders ON o_orderkey = k) GROUP BY 1""")
def j28_order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.floor(F.col("l_linenumber") % 7 / 6)).alias("o_orderkey"), "l_returnflag", F.lag("l_returnflag").over(order).alias("before"))
    known = t.read(spark, sf_dir, "orders").select("o_orderkey", F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "rejected_unknown").when(F.col("l_returnflag") == F.col("before"), "ignored_identical").otherwise("applied")
    return rows.join(known, "o_orderkey", "left").groupBy(action.alias("action")).agg(F.count("*").alias("updates"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'too_large' ELSE 'pending' END AS failure_type, sha256('failed|' || o_orderkey || '|' || CASE WHEN o_totalprice > 300000 THEN 'too_large' ELSE 'pending' END) AS failure_id FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def j29_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_totalprice") > 300000, "too_large").when(F.col("o_orderstatus") == "P", "pending")
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("failure_type")).where("failure_type IS NOT NULL")
    return rows.withColumn("failure_id", F.sha2(F.concat_ws("|", F.lit("failed"), F.col("o_orderkey").cast("string"), "failure_type"), 256))


_LABELED = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'validation' ELSE 'final' END"


@query(f"""WITH l AS (SELECT CAST(o_orderdate AS DATE) AS d, {_LABELED} AS phase, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT min(d) FILTER (WHERE phase <> 'train') AS b1, min(d) FILTER (WHERE phase = 'final') AS b2 FROM l)
    SELECT CAST(d AS VARCHAR) AS session, phase, 'SESSION_REPEATED' AS code FROM l WHERE n > 1 UNION ALL SELECT CAST(d AS VARCHAR), phase, 'PHASES_OVERLAP' FROM (SELECT *, count(*) OVER (PARTITION BY d) AS k FROM l) WHERE k > 1
    UNION ALL SELECT CAST(d AS VARCHAR), phase, 'OUT_OF_ORDER' FROM l, b WHERE (phase = 'train' AND d > b1) OR (phase = 'validation' AND d > b2)""")
def k19_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as a table of labels, by the orders' status: it repeats sessions, and its phases run into each other."""
    labels = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session_date"), F.expr(_LABELED).alias("phase"))
    return robustness.label_faults(labels).select(F.col("session_date").cast("string").alias("session"), "phase", "code")


@query(f"""SELECT 'bars' AS artifact, count(*) AS rows, CAST(NULL AS VARCHAR) AS parent FROM ({t.bars_sql()}) UNION ALL SELECT 'sessions', count(DISTINCT (symbol, session_date)), 'bars' FROM ({t.bars_sql()}) UNION ALL SELECT 'ticks', count(*), NULL FROM events""")
def r7_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    row = lambda df, name, n, parent: df.agg(n.alias("rows")).select(F.lit(name).alias("artifact"), "rows", F.lit(parent).cast("string").alias("parent"))
    return row(bars, "bars", F.count("*"), None).unionByName(row(bars, "sessions", F.countDistinct("symbol", "session_date"), "bars")).unionByName(row(t.ticks(spark, sf_dir), "ticks", F.count("*"), None))


@query("""SELECT user_id, event_type AS state, CAST(CAST(ts AS DATE) AS VARCHAR) AS session FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type IN ('click', 'view')""")
def s12_open_at_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    last = t.read(spark, sf_dir, "events").groupBy("user_id", day.alias("d")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.where(F.col("state").isin("click", "view")).select("user_id", "state", F.col("d").cast("string").alias("session"))


@query("SELECT o_orderkey, CAST(floor(100000 / o_totalprice) AS BIGINT) AS equal_notional, CAST(CASE WHEN o_orderkey % 9 > 0 THEN floor(500 / (o_totalprice - o_totalprice * (1 - (o_orderkey % 9) / 100.0::DOUBLE))) ELSE 0 END AS BIGINT) AS equal_risk FROM orders")
def f7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    stop = price * (1 - (F.col("o_orderkey") % 9) / 100.0)
    sized = trades.equal_risk_quantity(F.lit(500.0), price, F.when(F.col("o_orderkey") % 9 > 0, stop).otherwise(price))
    return t.read(spark, sf_dir, "orders").select("o_orderkey", trades.quantity(F.lit(100000.0), price).alias("equal_notional"), sized.cast("long").alias("equal_risk"))


@query(f"""SELECT strategy_id, scenario, count(*) AS trade_count, round(sum(p), 2) AS net_pnl, round(sum(CASE WHEN p > 0 THEN p ELSE 0 END) / nullif(sum(CASE WHEN p < 0 THEN -p ELSE 0 END), 0), 6) AS profit_factor
    FROM (SELECT strategy_id, scenario, CAST(net_pnl AS DOUBLE) - notional * bps / 10000 AS p FROM ({t.TRADES}), (VALUES ('optimistic', 1.0::DOUBLE), ('base', 3.0::DOUBLE), ('stress', 7.0::DOUBLE)) c(scenario, bps)) GROUP BY ALL""")
def h8_scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.with_scenarios(t.trades(spark, sf_dir))
    own = rows.withColumn("net_pnl", F.col("net_pnl").cast("double") - F.col("notional") * F.col("impact_bps") / 10000).withColumn("cost_paid", F.col("cost_paid").cast("double"))
    out = metrics.trade_metrics(own, "strategy_id", "scenario")
    return out.select("strategy_id", "scenario", "trade_count", F.round("net_pnl", 2).alias("net_pnl"), F.round("profit_factor", 6).alias("profit_factor"))


@query(f"""SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS sessions, CAST(sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(*) FILTER (WHERE price <= 1) AS quarantined
    FROM (SELECT *, CAST(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS BIGINT) AS gap FROM ({t.TICKS})) GROUP BY 1""")
def r8_import_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.streaming.bars import feed_health

    ticks = t.ticks(spark, sf_dir)
    gaps = feed_health(ticks, 1800).groupBy("symbol").agg(F.sum("gaps").alias("gaps"))
    own = ticks.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("session_date").alias("sessions"), F.count_if(F.col("price") <= 1).alias("quarantined"))
    return own.join(gaps, "symbol")
