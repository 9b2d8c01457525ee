"""Queries for robustness, eligibility and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import metrics, reports, robustness
from tickloom.operators.features import resample
from tickloom.plans import tables as t
from tickloom.plans.bar_queries import _blocks
from tickloom.plans.registry import query
from tickloom.plans.trade_queries import _RETURNS, CASH, daily_equity

_YEARLY = f"SELECT strategy_id, year(session_date) AS y, list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY session_date)), lambda a, x: a * (1 + x)) - 1 AS net_return, max(-r) AS max_drawdown FROM ({_RETURNS}) GROUP BY ALL"


@query(f"SELECT strategy_id, count(*) AS points, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 9) AS profitable_share, round(max(max_drawdown), 9) AS worst_drawdown, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AND max(max_drawdown) <= 0.08 AS stable FROM ({_YEARLY}) GROUP BY strategy_id")
def k6_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = metrics.session_returns(daily_equity(spark, sf_dir), CASH)
    path = F.transform(F.array_sort(F.collect_list(F.struct("session_date", "session_return"))), lambda x: x["session_return"])
    years = returns.groupBy("strategy_id", F.year("session_date").alias("y")).agg(path.alias("r"), F.max(-F.col("session_return")).alias("max_drawdown")).select("strategy_id", metrics.compounded(F.col("r")).alias("net_return"), "max_drawdown")
    out = robustness.neighborhood(years)
    return out.select("strategy_id", "points", F.round("profitable_share", 9).alias("profitable_share"), F.round("worst_drawdown", 9).alias("worst_drawdown"), "stable")


_OFFSETS = (0, 5, 20, -1, -10)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY session_date) AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM ({_RETURNS}))
    SELECT strategy_id, o AS "offset", round(list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY session_date)), lambda a, x: a * (1 + x)) - 1, 9) AS net_return
    FROM r, (VALUES {', '.join(f'({o})' for o in _OFFSETS)}) v(o) WHERE (o >= 0 AND i > o) OR (o < 0 AND i <= n + o) GROUP BY ALL""")
def k7_start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.start_offsets(metrics.session_returns(daily_equity(spark, sf_dir), CASH), _OFFSETS)
    return out.select("strategy_id", "offset", F.round("net_return", 9).alias("net_return"))


@query("""WITH v AS (SELECT p_brand AS hypothesis_id, p_partkey AS variant_rank FROM part)
    SELECT hypothesis_id, variant_rank, neighbour FROM (SELECT a.hypothesis_id, a.variant_rank, b.variant_rank AS neighbour, row_number() OVER (PARTITION BY a.hypothesis_id, a.variant_rank ORDER BY b.variant_rank) AS r
    FROM v a JOIN v b ON a.hypothesis_id = b.hypothesis_id AND a.variant_rank <> b.variant_rank) WHERE r <= 5""")
def k16_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.first_neighbours(t.read(spark, sf_dir, "part").select(F.col("p_brand").alias("hypothesis_id"), F.col("p_partkey").alias("variant_rank")))


@query("""WITH s AS (SELECT l_returnflag AS strategy_id, l_linestatus AS method, l_extendedprice AS score FROM lineitem), o AS (SELECT l_returnflag AS strategy_id, max(l_extendedprice) AS profit FROM lineitem GROUP BY 1),
    x AS (SELECT strategy_id, method, quantile_disc(score, 0.95) AS threshold FROM s GROUP BY ALL)
    SELECT o.strategy_id, coalesce(bool_and(profit > threshold), false) AS null_test_passed, max(threshold) AS threshold FROM o LEFT JOIN x USING (strategy_id) GROUP BY 1""")
def k14_null_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.read(spark, sf_dir, "lineitem")
    scores = lines.select(F.col("l_returnflag").alias("strategy_id"), F.col("l_linestatus").alias("method"), F.col("l_extendedprice").alias("score"))
    return robustness.null_verdict(lines.groupBy(F.col("l_returnflag").alias("strategy_id")).agg(F.max("l_extendedprice").alias("profit")), scores)


@query("SELECT sha256(string_agg(o_orderpriority || '=' || h, '|' ORDER BY o_orderpriority || '=' || h)) AS selection_sha256, count(*) AS survivors FROM (SELECT o_orderpriority, sha256(CAST(count(*) AS VARCHAR)) AS h FROM orders GROUP BY 1)")
def j16_selection_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sha2(F.count("*").cast("string"), 256).alias("h"))
    return robustness.selection_hash(own, "o_orderpriority", "h")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_extendedprice / l_quantity - p_retailprice) / p_retailprice * 10000, 4) AS slippage_bps FROM lineitem JOIN part ON l_partkey = p_partkey")
def r2_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("p_retailprice").alias("limit_price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"))
    return reports.slippage(own).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("slippage_bps", 4).alias("slippage_bps"))


@query("""SELECT CAST(o AS INTEGER) AS ordinal, phase, CAST(n AS BIGINT) AS rows FROM (SELECT count(*) AS a, count(*) FILTER (WHERE o_totalprice > 100000) AS b, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F') AS c FROM orders),
    LATERAL (VALUES (1, 'all', a), (2, 'large', b), (3, 'final', c)) v(o, phase, n)""")
def r5_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(t.read(spark, sf_dir, "orders"), [("all", "true"), ("large", "o_totalprice > 100000"), ("final", "o_orderstatus = 'F'")])


@query(f"""SELECT '1h' AS bar_size, symbol, count(*) AS rows FROM ({t.bars_sql()}) GROUP BY symbol UNION ALL SELECT '2h', symbol, count(*) FROM ({_blocks(2)}) GROUP BY symbol UNION ALL SELECT '4h', symbol, count(*) FROM ({_blocks(4)}) GROUP BY symbol""")
def r6_bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    return reports.size_counts({"1h": bars, "2h": resample(bars, 2), "4h": resample(bars, 4)}, "symbol")
