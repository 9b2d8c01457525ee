"""Queries over signals and trades: as-of joins, fills, lots, metrics, splits, null tests, gates, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import gates, metrics, nulls, trades
from tickloom.plans import tables as t
from tickloom.plans.bar_queries import RULES, SIGNALS, rounded
from tickloom.plans.registry import query
from tickloom.operators import rules

CASH = 10_000_000.0
_BARS = f"b AS ({t.bars_sql()}), f AS ({t.FEATURES}), s AS ({SIGNALS})"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.signals(t.feature_frame(spark, sf_dir), RULES, ("symbol", "session_date", "slot", "bar_start"))


def bar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).withColumn("bar", F.struct("slot", "open", "close"))


@query(f"""WITH {_BARS} SELECT s.strategy_id, s.symbol, s.session_date, s.slot, coalesce(b.slot, -1) AS entry_slot, b.open AS entry_open
    FROM s ASOF LEFT JOIN b ON s.symbol = b.symbol AND s.session_date = b.session_date AND s.bar_start < b.bar_start""")
def f1_next_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trades.as_of(signals(spark, sf_dir), bar_values(spark, sf_dir), ("symbol", "session_date"), "bar_start", "bar_start", "bar", "after", True, "next")
    return out.select("strategy_id", "symbol", "session_date", "slot", F.coalesce("next.slot", F.lit(-1)).alias("entry_slot"), F.col("next.open").alias("entry_open"))


@query(f"""WITH {_BARS}, l AS (SELECT symbol, session_date, max(slot) AS last_slot, last(close ORDER BY slot) AS last_close FROM b GROUP BY ALL)
    SELECT s.strategy_id, s.symbol, s.session_date, s.slot, coalesce(b.slot, last_slot) AS exit_slot, coalesce(b.close, last_close) AS exit_close
    FROM (SELECT *, bar_start + INTERVAL 4 HOUR AS target FROM s) s ASOF LEFT JOIN b ON s.symbol = b.symbol AND s.session_date = b.session_date AND s.target <= b.bar_start
    JOIN l ON s.symbol = l.symbol AND s.session_date = l.session_date""")
def f2_exit_at_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bar_values(spark, sf_dir)
    wanted = signals(spark, sf_dir).withColumn("target", F.col("bar_start") + F.expr("interval 4 hours"))
    out = trades.as_of(wanted, bars, ("symbol", "session_date"), "target", "bar_start", "bar", "after", False, "at")
    last = bars.groupBy("symbol", "session_date").agg(F.max("bar").alias("last"))
    return out.join(last, ["symbol", "session_date"]).select("strategy_id", "symbol", "session_date", "slot", F.coalesce("at.slot", "last.slot").alias("exit_slot"), F.coalesce("at.close", "last.close").alias("exit_close"))


@query(f"""WITH b AS ({t.bars_sql()}), e AS (SELECT event_id, event_type AS symbol, CAST(ts AS DATE) AS session_date, ts FROM events)
    SELECT e.event_id, coalesce(b.slot, -1) AS slot, b.close FROM e ASOF LEFT JOIN b ON e.symbol = b.symbol AND e.session_date = b.session_date AND e.ts > b.bar_start""")
def f3_last_bar_before_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.ticks(spark, sf_dir).select("event_id", "symbol", "session_date", "ts")
    out = trades.as_of(events, bar_values(spark, sf_dir), ("symbol", "session_date"), "ts", "bar_start", "bar", "before", True, "bar")
    return out.select("event_id", F.coalesce("bar.slot", F.lit(-1)).alias("slot"), "bar.close")


@query(f"""WITH b AS ({t.bars_sql()}), o AS (SELECT symbol, session_date, slot AS order_id, bar_start AS signal_time, close * 0.9 AS limit_price FROM b)
    SELECT o.symbol, o.session_date, o.order_id, coalesce(min(b.slot), -1) AS fill_slot, CASE WHEN count(b.slot) > 0 THEN round(o.limit_price, 6) END AS fill_price
    FROM o LEFT JOIN b ON b.symbol = o.symbol AND b.session_date = o.session_date AND b.bar_start > o.signal_time AND b.low <= o.limit_price GROUP BY o.symbol, o.session_date, o.order_id, o.limit_price""")
def f5_limit_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    orders = bars.select("symbol", "session_date", F.col("slot").alias("order_id"), F.col("bar_start").alias("signal_time"), F.lit("buy").alias("side"), (F.col("close") * 0.9).alias("limit_price"))
    out = trades.limit_fills(orders, bars)
    return out.select("symbol", "session_date", "order_id", F.coalesce(F.hour("fill_time"), F.lit(-1)).alias("fill_slot"), F.round("fill_price", 6).alias("fill_price"))


@query(f"""WITH b AS ({t.bars_sql()}), p AS (SELECT e.symbol, e.session_date, e.slot AS entry_id, b.slot, b.close AS c, e.close AS entry_price, b.slot - e.slot AS held
        FROM b e JOIN b ON b.symbol = e.symbol AND b.session_date = e.session_date AND b.slot > e.slot),
    m AS (SELECT symbol, session_date, entry_id, min(slot) FILTER (WHERE c <= entry_price * (1 - 2000 / 10000.0::DOUBLE)) AS s, min(slot) FILTER (WHERE c >= entry_price * (1 + 3000 / 10000.0::DOUBLE)) AS p,
        min(slot) FILTER (WHERE held >= 6) AS h, max(slot) AS e FROM p GROUP BY ALL)
    SELECT symbol, session_date, entry_id, least(s, p, h, e) AS exit_slot, CASE least(s, p, h, e) WHEN s THEN 'stop_loss' WHEN p THEN 'take_profit' WHEN h THEN 'max_holding' ELSE 'session_close' END AS exit_reason FROM m""")
def f6_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    entries = bars.select("symbol", "session_date", F.col("slot").alias("entry_id"), F.col("bar_start").alias("entry_time"), F.col("close").alias("entry_price"))
    return trades.exits(entries, bars, 2000, 3000, 360).select("symbol", "session_date", "entry_id", F.hour("exit_time").alias("exit_slot"), "exit_reason")


@query("""SELECT o_orderkey, b.balance, CAST(least(floor(b.balance / price), floor(b.balance * 0.25::DOUBLE / price), floor(b.balance * 0.005::DOUBLE / (price * 0.02::DOUBLE))) AS BIGINT) AS quantity
    FROM (SELECT o_orderkey, o_totalprice / 1000 AS price FROM orders) CROSS JOIN (VALUES (5000), (10000), (25000)) b(balance)""")
def f9_balance_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"))
    size = trades.conservative_size(F.col("balance"), F.col("balance"), F.col("price"), F.col("price") * 0.02)
    return trades.with_balances(rows).select("o_orderkey", "balance", size["quantity"].cast("long").alias("quantity"))


@query(f"""WITH {_BARS}, x AS (SELECT s.*, b.open FROM s ASOF JOIN b ON s.symbol = b.symbol AND s.session_date = b.session_date AND s.bar_start < b.bar_start)
    SELECT strategy_id, symbol, session_date, slot, scenario, round(open * (1 + bps / 10000), 6) AS entry_price FROM x CROSS JOIN (VALUES ('optimistic', 1.0::DOUBLE), ('base', 3.0::DOUBLE), ('stress', 7.0::DOUBLE)) c(scenario, bps)""")
def f11_cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trades.as_of(signals(spark, sf_dir), bar_values(spark, sf_dir), ("symbol", "session_date"), "bar_start", "bar_start", "bar", "after", True, "next").where("next IS NOT NULL")
    out = trades.with_scenarios(found)
    price = trades.market_price(F.col("next.open"), F.lit("buy"), F.col("impact_bps"))
    return out.select("strategy_id", "symbol", "session_date", "slot", "scenario", F.round(price, 6).alias("entry_price"))


# The fold over a session's entries in time order: what was taken so far, and each decision.
@query(f"""WITH {_BARS}, e AS (SELECT strategy_id, symbol, session_date, CAST(slot AS INTEGER) AS entry_id, CAST(slot * 3600 AS INTEGER) AS entry_s, CAST((slot + 3) * 3600 AS INTEGER) AS exit_s FROM s),
    g AS (SELECT strategy_id, session_date, list({{'y': symbol, 'i': entry_id, 'e': entry_s, 'x': exit_s, 'taken': CAST([] AS STRUCT(y VARCHAR, x INTEGER)[]), 'ok': CAST([] AS BOOLEAN[])}} ORDER BY entry_s, symbol, entry_id) AS rows FROM e GROUP BY ALL),
    d AS (SELECT strategy_id, session_date, rows, list_reduce(list_prepend({{'y': '', 'i': 0, 'e': 0, 'x': 0, 'taken': CAST([] AS STRUCT(y VARCHAR, x INTEGER)[]), 'ok': CAST([] AS BOOLEAN[])}}, rows), lambda a, r: {{'y': r.y, 'i': r.i, 'e': r.e, 'x': r.x,
        'taken': CASE WHEN len(a.taken) < 6 AND len(list_filter(a.taken, lambda k: k.x > r.e)) < 2 AND len(list_filter(a.taken, lambda k: k.y = r.y AND r.e < k.x + 3600)) = 0 THEN list_append(a.taken, {{'y': r.y, 'x': r.x}}) ELSE a.taken END,
        'ok': list_append(a.ok, len(a.taken) < 6 AND len(list_filter(a.taken, lambda k: k.x > r.e)) < 2 AND len(list_filter(a.taken, lambda k: k.y = r.y AND r.e < k.x + 3600)) = 0)}}) AS last FROM g)
    SELECT strategy_id, u.r.y AS symbol, session_date, u.r.i AS entry_id, u.r.e AS entry_s, u.r.x AS exit_s, u.ok AS accepted FROM (SELECT strategy_id, session_date, unnest(list_transform(range(len(rows)), lambda n: {{'r': rows[n + 1], 'ok': last.ok[n + 1]}})) AS u FROM d)""")
def f12_accepted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = signals(spark, sf_dir).select("strategy_id", "symbol", "session_date", F.col("slot").alias("entry_id"), (F.col("slot") * 3600).alias("entry_s"), ((F.col("slot") + 3) * 3600).alias("exit_s"))
    return trades.accept_entries(entries, 3600, 6, 2)


@query(f"""WITH b AS ({t.bars_sql()}), tr AS (SELECT symbol, session_date, slot, least(slot + 3, 23) AS out_slot, volume AS quantity, close FROM b WHERE slot % 3 = 0)
    SELECT b.symbol, b.session_date, b.slot, CAST(coalesce(sum(tr.quantity) FILTER (WHERE tr.slot <= b.slot AND b.slot < tr.out_slot), 0) AS BIGINT) AS held,
        round(coalesce(sum(tr.quantity) FILTER (WHERE tr.slot <= b.slot AND b.slot < tr.out_slot), 0) * b.close, 6) AS market_value, CAST(coalesce(sum(tr.quantity) FILTER (WHERE tr.out_slot <= b.slot), 0) AS BIGINT) AS realised
    FROM b LEFT JOIN tr ON tr.symbol = b.symbol AND tr.session_date = b.session_date GROUP BY b.symbol, b.session_date, b.slot, b.close""")
def f14_equity_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    hour = lambda s: F.timestamp_seconds(F.unix_timestamp(F.col("session_date").cast("timestamp")) + 3600 * s)
    own = bars.where("slot % 3 = 0").select("symbol", "session_date", hour(F.col("slot")).alias("entry_time"), hour(F.least(F.col("slot") + 3, F.lit(23))).alias("exit_time"), F.col("volume").alias("quantity"), F.col("volume").cast("double").alias("net_pnl"))
    out = trades.equity_marks(own, bars)
    return out.select("symbol", "session_date", F.hour("bar_start").alias("slot"), "held", F.round("market_value", 6).alias("market_value"), F.col("realised").cast("long").alias("realised"))


_LOG = """SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rank FROM lineitem"""


@query(f"""WITH c AS MATERIALIZED (SELECT *, sum(CASE side WHEN 'buy' THEN quantity ELSE 0 END) OVER w AS bought, sum(CASE side WHEN 'sell' THEN quantity ELSE 0 END) OVER w AS sold FROM ({_LOG}) WINDOW w AS (PARTITION BY l_partkey ORDER BY rank)),
    d AS MATERIALIZED (SELECT *, greatest(0, max(sold - bought) OVER (PARTITION BY l_partkey ORDER BY rank)) AS lost FROM c), e AS MATERIALIZED (SELECT *, coalesce(lag(lost) OVER (PARTITION BY l_partkey ORDER BY rank), 0) AS before FROM d),
    i AS MATERIALIZED (SELECT l_partkey, side, rank, CASE side WHEN 'buy' THEN bought - quantity ELSE sold - quantity - before END AS p, CASE side WHEN 'buy' THEN bought ELSE sold - lost END AS q FROM e),
    m AS (SELECT l_partkey, side, last_value(CASE side WHEN 'buy' THEN rank END IGNORE NULLS) OVER r AS buy_rank, last_value(CASE side WHEN 'buy' THEN p END IGNORE NULLS) OVER r AS b0, last_value(CASE side WHEN 'buy' THEN q END IGNORE NULLS) OVER r AS b1,
        last_value(CASE side WHEN 'sell' THEN rank END IGNORE NULLS) OVER r AS sell_rank, last_value(CASE side WHEN 'sell' THEN p END IGNORE NULLS) OVER r AS s0, last_value(CASE side WHEN 'sell' THEN q END IGNORE NULLS) OVER r AS s1
        FROM i WHERE q > p WINDOW r AS (PARTITION BY l_partkey ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT l_partkey, buy_rank, sell_rank, CAST(least(b1, s1) - greatest(b0, s0) AS BIGINT) AS quantity FROM m WHERE (side = 'buy' AND b0 >= s0 OR side = 'sell' AND s0 > b0) AND least(b1, s1) > greatest(b0, s0)""")
def f15_fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.read(spark, sf_dir, "lineitem")
    log = lines.select("*", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("long").alias("quantity"))
    order = ["l_shipdate", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    lots = trades.fifo_lots(log, ("l_partkey",), order)
    return lots.select("l_partkey", F.col("buy_rank").cast("long").alias("buy_rank"), F.col("sell_rank").cast("long").alias("sell_rank"), F.col("quantity").cast("long").alias("quantity"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name""")
def f16_dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = t.read(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nation = t.read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t.read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    rows = customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.sum("c").alias("cents"))


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount >= 0.09)")
def f18_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.09D").select(F.col("l_partkey").alias("p_partkey"))
    return t.read(spark, sf_dir, "part").join(lines, "p_partkey", "left_anti").select("p_partkey", "p_brand")


_DAILY = f"SELECT strategy_id, session_date, sum(net_pnl) AS pnl FROM ({t.TRADES}) GROUP BY ALL"
_EQUITY = f"SELECT strategy_id, session_date, CAST({CASH} + sum(pnl) OVER (PARTITION BY strategy_id ORDER BY session_date) AS DOUBLE) AS equity FROM ({_DAILY})"
_RETURNS = f"SELECT strategy_id, session_date, equity, equity / lag(equity, 1, {CASH}::DOUBLE) OVER (PARTITION BY strategy_id ORDER BY session_date) - 1 AS r FROM ({_EQUITY})"


def daily_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    daily = t.trades(spark, sf_dir).groupBy("strategy_id", "session_date").agg(F.sum("net_pnl").alias("pnl"))
    total = F.sum("pnl").over(Window.partitionBy("strategy_id").orderBy("session_date"))
    return daily.select("strategy_id", "session_date", F.col("session_date").alias("event_time"), (total + F.lit(CASH).cast("decimal(18,4)")).cast("double").alias("equity"))


@query(f"SELECT strategy_id, session_date, round(r, 9) AS session_return FROM ({_RETURNS})")
def h1_session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.session_returns(daily_equity(spark, sf_dir), CASH).select("strategy_id", "session_date", F.round("session_return", 9).alias("session_return"))


@query(f"SELECT strategy_id, round(greatest(0, max(1 - equity / greatest({CASH}, peak))), 9) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY session_date) AS peak FROM ({_EQUITY})) GROUP BY strategy_id")
def h2_max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.max_drawdown(daily_equity(spark, sf_dir), CASH).select("strategy_id", F.round("max_drawdown", 9).alias("max_drawdown"))


@query(f"SELECT strategy_id, round(stddev_samp(r) * sqrt(252), 6) AS annualized_volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM ({_RETURNS}) GROUP BY strategy_id")
def h3_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.risk(metrics.session_returns(daily_equity(spark, sf_dir), CASH)), "annualized_volatility", "sharpe")


def _metrics_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS trade_count, round(coalesce(sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN net_pnl < 0 THEN -net_pnl ELSE 0 END)::DOUBLE, 0), 0), 6) AS profit_factor,
        round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(net_pnl)::DOUBLE / count(*), 4) AS expectancy, CAST(sum(cost_paid) AS DOUBLE) AS cost_paid, CAST(sum(net_pnl) AS DOUBLE) AS net_pnl FROM ({t.TRADES}) GROUP BY {keys}"""


def _trade_metrics(df: DataFrame, *keys: str) -> DataFrame:
    out = metrics.trade_metrics(df, *keys)
    number = lambda c, n: F.round(F.col(c).cast("double"), n).alias(c)
    mean = F.round(F.col("net_pnl").cast("double") / F.col("trade_count"), 4).alias("expectancy")
    return out.select(*keys, "trade_count", number("profit_factor", 6), number("win_rate", 6), mean, F.col("cost_paid").cast("double").alias("cost_paid"), F.col("net_pnl").cast("double").alias("net_pnl"))


@query(_metrics_sql("strategy_id"))
def h4_trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_metrics(t.trades(spark, sf_dir), "strategy_id")


@query(_metrics_sql("strategy_id, symbol"))
def h6_metrics_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_metrics(t.trades(spark, sf_dir), "strategy_id", "symbol")


@query(f"UNPIVOT (SELECT strategy_id, CAST(trade_count AS DOUBLE) AS trade_count, profit_factor, win_rate FROM ({_metrics_sql('strategy_id')})) ON trade_count, profit_factor, win_rate INTO NAME metric VALUE value")
def h7_long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_form(_trade_metrics(t.trades(spark, sf_dir), "strategy_id").select("strategy_id", "trade_count", "profit_factor", "win_rate"), "strategy_id")


@query(f"SELECT strategy_id, year(session_date)::INTEGER AS year, round(list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY session_date)), lambda a, x: a * (1 + x)) - 1, 9) AS compounded FROM ({_RETURNS}) GROUP BY ALL")
def h10_compounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = metrics.session_returns(daily_equity(spark, sf_dir), CASH)
    rows = returns.groupBy("strategy_id", F.year("session_date").alias("year")).agg(F.array_sort(F.collect_list(F.struct("session_date", "session_return"))).alias("r"))
    return rows.select("strategy_id", "year", F.round(metrics.compounded(F.transform("r", lambda x: x["session_return"])), 9).alias("compounded"))


@query(f"""WITH tr AS (SELECT strategy_id, symbol, session_date, CAST(net_pnl AS DECIMAL(28,4)) AS net_pnl FROM ({t.TRADES})),
    d AS (SELECT strategy_id, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS dc FROM (SELECT strategy_id, session_date, sum(net_pnl) AS p FROM tr GROUP BY ALL) GROUP BY ALL),
    w AS (SELECT strategy_id, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS wc FROM (SELECT strategy_id, isoyear(session_date), weekofyear(session_date), sum(net_pnl) AS p FROM tr GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT strategy_id, max(n) / sum(n) AS sc FROM (SELECT strategy_id, symbol, count(*) AS n FROM tr GROUP BY ALL) GROUP BY ALL)
    SELECT strategy_id, round(dc, 9) AS day_consistency, round(wc, 9) AS week_consistency, round(sc, 9) AS symbol_concentration FROM d JOIN w USING (strategy_id) JOIN s USING (strategy_id)""")
def h12_forward_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.trades(spark, sf_dir).select("*", (F.col("net_pnl") / F.col("notional")).cast("double").alias("net_return"), F.xxhash64("notional", "net_pnl").alias("trade_id")).withColumn("net_pnl", F.col("net_pnl").cast("double"))
    return metrics.forward_metrics(own).select("strategy_id", *[F.round(c, 9).alias(c) for c in ("day_consistency", "week_consistency", "symbol_concentration")])


_SESSIONS = "SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events"


@query(f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i, count(*) OVER () AS n FROM ({_SESSIONS})),
    c AS (SELECT *, n * 7 // 10 AS a, n * 2 // 10 AS b, n // 10 AS c, n * 7 % 10 AS ra, n * 2 % 10 AS rb, n % 10 AS rc FROM s),
    d AS (SELECT *, n - a - b - c AS rest FROM c), e AS (SELECT *, a + CASE WHEN (CASE WHEN rb > ra THEN 1 ELSE 0 END + CASE WHEN rc > ra THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS ta, b + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END + CASE WHEN rc > rb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS tb FROM d)
    SELECT session_date, CASE WHEN i <= ta THEN 'train' WHEN i <= ta + tb THEN 'validation' ELSE 'final' END AS phase FROM e""")
def k1_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chronological_split(t.ticks(spark, sf_dir))


@query(f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM ({_SESSIONS}))
    SELECT CAST(w AS INTEGER) AS window_id, session_date, CASE WHEN i - w * 3 < 10 THEN 'train' ELSE 'evaluation' END AS role FROM s, range(1000) r(w) WHERE w <= (n - 15) // 3 AND n >= 15 AND i >= w * 3 AND i < w * 3 + 15""")
def k4_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.walk_forward(t.ticks(spark, sf_dir), 10, 5, 3)


@query(f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM ({_SESSIONS})),
    m AS (SELECT CAST(w AS INTEGER) AS window_id, session_date FROM s, range(1000) r(w) WHERE w <= (n - 15) // 3 AND n >= 15 AND i >= w * 3 + 10 AND i < w * 3 + 15)
    SELECT window_id, symbol, count(*) AS bars, sum(CASE WHEN close > open THEN 1 ELSE 0 END)::BIGINT AS rising FROM m JOIN ({t.bars_sql()}) USING (session_date) GROUP BY ALL""")
def k5_walk_forward_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = metrics.walk_forward(t.ticks(spark, sf_dir), 10, 5, 3).where("role = 'evaluation'")
    return t.bars(spark, sf_dir).join(F.broadcast(windows), "session_date").groupBy("window_id", "symbol").agg(F.count("*").alias("bars"), F.sum((F.col("close") > F.col("open")).cast("long")).alias("rising"))


@query(f"SELECT strategy_id, symbol, CAST(greatest(p, 0) / nullif(sum(greatest(p, 0)) OVER (PARTITION BY strategy_id), 0) > 0.7 AS BOOLEAN) AS concentrated FROM (SELECT strategy_id, symbol, sum(net_pnl)::DOUBLE AS p FROM ({t.TRADES}) GROUP BY ALL)")
def k8_symbol_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = t.trades(spark, sf_dir).groupBy("strategy_id", "symbol").agg(F.sum("net_pnl").cast("double").alias("p"))
    gain = F.greatest("p", F.lit(0.0))
    total = F.sum(gain).over(Window.partitionBy("strategy_id"))
    return by.select("strategy_id", "symbol", (gain / F.nullif(total, F.lit(0.0)) > 0.7).alias("concentrated"))


REPS = 200
_OPP = "SELECT event_id AS opportunity_id, event_type AS symbol, CAST(ts AS DATE) AS session_date, event_type = 'purchase' AS entered, CAST(round(value * 100) AS BIGINT) AS profit FROM events"


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "events").select(F.col("event_id").alias("opportunity_id"), F.col("event_type").alias("symbol"), F.to_date("ts").alias("session_date"), (F.col("event_type") == "purchase").alias("entered"), F.round(F.col("value") * 100).cast("long").alias("profit"))


@query(f"""WITH o AS (SELECT *, count(*) FILTER (WHERE entered) OVER (PARTITION BY session_date) AS marks FROM ({_OPP})),
    r AS (SELECT rep, profit, row_number() OVER (PARTITION BY session_date, rep ORDER BY draw, opportunity_id) <= marks AS shuffled FROM (SELECT *, {nulls.draw_sql("opportunity_id", "rep", 0)} AS draw FROM o, range({REPS}) t(rep)))
    SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(profit) AS BIGINT) AS profit FROM r WHERE shuffled GROUP BY rep""")
def k9_permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profit of each dealing of a session's marks among all its opportunities."""
    at = F.lit(0)
    rows = opportunities(spark, sf_dir).withColumns({"strategy_id": F.lit("all"), "symbol": F.lit("all"), "signal_s": at, "entry_s": at, "exit_s": at})
    return nulls.profits(rows, REPS).where(F.col("method") == nulls.PERMUTED).select("rep", "profit")


@query(f"""WITH p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY opportunity_id) - 1 AS pos, count(*) OVER (PARTITION BY session_date) AS n FROM ({_OPP})),
    m AS (SELECT session_date, rep, (pos + CAST('0x' || substr(md5('shift|' || rep || '|' || session_date), 1, 8) AS BIGINT) % (n - 1) + 1) % n AS pos FROM p, range({REPS}) t(rep) WHERE n > 1 AND entered)
    SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(profit) AS BIGINT) AS profit FROM p JOIN m USING (session_date, pos) GROUP BY rep""")
def k10_shift_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shifted_profits(opportunities(spark, sf_dir), REPS)


@query("SELECT event_type AS symbol, quantile_disc(value, 0.95) AS threshold FROM events GROUP BY 1")
def k13_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(t.ticks(spark, sf_dir), "price", 0.95, "symbol")


_COMPONENTS = ("expectancy", "cost_paid", "win_rate")


@query(f"""WITH m AS (SELECT symbol AS cohort, strategy_id, expectancy, cost_paid, win_rate FROM ({_metrics_sql('strategy_id, symbol')})),
    p AS (SELECT cohort, strategy_id, dense_rank() OVER (PARTITION BY cohort ORDER BY expectancy DESC) - 1 AS e, dense_rank() OVER (PARTITION BY cohort ORDER BY cost_paid) - 1 AS c, dense_rank() OVER (PARTITION BY cohort ORDER BY win_rate DESC) - 1 AS w FROM m),
    n AS (SELECT *, max(e) OVER o AS me, max(c) OVER o AS mc, max(w) OVER o AS mw FROM p WINDOW o AS (PARTITION BY cohort)),
    s AS (SELECT cohort, strategy_id, round(0.5::DOUBLE * coalesce(1 - e / nullif(me, 0)::DOUBLE, 1) + 0.3::DOUBLE * coalesce(1 - c / nullif(mc, 0)::DOUBLE, 1) + 0.2::DOUBLE * coalesce(1 - w / nullif(mw, 0)::DOUBLE, 1), 9) AS score FROM n)
    SELECT cohort, strategy_id, score, CAST(row_number() OVER (PARTITION BY cohort ORDER BY score DESC, strategy_id) AS INTEGER) AS rank FROM s""")
def l5_cross_sectional_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _trade_metrics(t.trades(spark, sf_dir), "strategy_id", "symbol").withColumnRenamed("symbol", "cohort")
    return gates.rank_scores(own.select("cohort", "strategy_id", *_COMPONENTS), {"expectancy": 0.5, "cost_paid": 0.3, "win_rate": 0.2}, frozenset(("cost_paid",)), "cohort")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 3 ELSE 0 END")
def l7_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return gates.within_capacity(orders, {"1-URGENT": 20, "2-HIGH": 5, "3-MEDIUM": 3}, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("""WITH g AS (SELECT * FROM (VALUES (1), (2), (4)) a(hold), (VALUES (100), (250)) b(stop))
    SELECT g.hold, g.stop, symbol, count(*) AS bars, count(*) FILTER (WHERE volume >= hold AND (high - low) * 10000 >= stop * close)::BIGINT AS hits FROM g, (%s) GROUP BY ALL""" % t.bars_sql())
def l8_grid_over_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = gates.parameter_grid(spark, {"hold": [1, 4, 2], "stop": [100, 250]})
    cells = F.array(*[F.struct(F.lit(r.hold).alias("hold"), F.lit(r.stop).alias("stop")) for r in grid.collect()])  # a grid of few cells becomes part of the expression
    rows = t.bars(spark, sf_dir).select("symbol", "volume", "high", "low", "close", F.explode(cells).alias("g"))
    hit = (F.col("volume") >= F.col("g.hold")) & ((F.col("high") - F.col("low")) * 10000 >= F.col("g.stop") * F.col("close"))
    return rows.groupBy(F.col("g.hold").alias("hold"), F.col("g.stop").alias("stop"), "symbol").agg(F.count("*").alias("bars"), F.sum(hit.cast("long")).alias("hits"))
