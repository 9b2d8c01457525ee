"""Further queries: file fingerprints, replay in two parts, phase views, survivors, spread grids, provider comparison, more checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import evidence, gates, metrics, reports, robustness, trades

from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.trade_queries import _SESSIONS, CASH, daily_equity, _RETURNS


@query()
def a7_file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_fingerprints(spark, f"{sf_dir}/orders.parquet", "*.parquet")


@query("""SELECT user_id AS entity, last(event_type ORDER BY ts, event_id) AS payload, count(*) AS events FROM events GROUP BY user_id""")
def j7_replay_in_two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.read(spark, sf_dir, "events")
    cut = "ts <= TIMESTAMP_NTZ'2024-01-15'"
    part = lambda where: log.where(where).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n"))
    both = part(cut).unionByName(part(f"NOT ({cut})"))
    return both.groupBy(F.col("user_id").alias("entity")).agg(F.max("last").alias("l"), F.sum("n").alias("events")).select("entity", F.col("l.event_type").alias("payload"), "events")


@query("""SELECT o_orderkey, 'no_lines' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, 'shipped_before_order' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)""")
def j12_bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = t.read(spark, sf_dir, "orders"), t.read(spark, sf_dir, "lineitem")
    first = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    rows = orders.select("o_orderkey", "o_orderdate").join(first, "o_orderkey", "left")
    issues = F.array_compact(F.array(F.when(F.col("first").isNull(), "no_lines"), F.when(F.col("first") < F.col("o_orderdate"), "shipped_before_order")))
    return rows.select("o_orderkey", F.explode(issues).alias("issue"))


@query(f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i, count(*) OVER () AS n FROM ({_SESSIONS}))
    SELECT symbol, count(*) AS bars, sum(volume)::BIGINT AS ticks FROM ({t.bars_sql()}) JOIN s USING (session_date) WHERE i <= 21 AND n = 30 OR i <= round(n * 0.7) AND n <> 30 GROUP BY symbol""")
def k2_train_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = metrics.chronological_split(t.ticks(spark, sf_dir))
    return robustness.sealed_view(t.bars(spark, sf_dir), labels, "train", None).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("ticks"))


@query(f"""WITH r AS (SELECT strategy_id, year(session_date) AS y, list_reduce(list_prepend(1.0::DOUBLE, list(r ORDER BY session_date)), lambda a, x: a * (1 + x)) - 1 AS net FROM ({_RETURNS}) GROUP BY ALL)
    SELECT strategy_id, y AS year, round(CASE WHEN net <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 0.002 / net)) END, 9) AS cost_sensitivity FROM r""")
def h11_cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = metrics.session_returns(daily_equity(spark, sf_dir), CASH)
    path = F.transform(F.array_sort(F.collect_list(F.struct("session_date", "session_return"))), lambda x: x["session_return"])
    rows = returns.groupBy("strategy_id", F.year("session_date").cast("long").alias("year")).agg(metrics.compounded(path).alias("net"))
    return rows.select("strategy_id", "year", F.round(metrics.cost_sensitivity(F.col("net"), F.col("net") - 0.002), 9).alias("cost_sensitivity"))


@query("""WITH e AS (SELECT p_partkey AS strategy_id, p_size / 100.0::DOUBLE AS vr, (51 - p_size) / 100.0::DOUBLE AS fr, p_size / 1000.0::DOUBLE AS vd, 0.02::DOUBLE AS fd, 1 + p_size / 50.0::DOUBLE AS vp, 2.0::DOUBLE AS fp, 0.1::DOUBLE AS vs, p_size / 100.0::DOUBLE AS fs, 0.8::DOUBLE AS wf FROM part WHERE p_size BETWEEN 1 AND 50),
    q AS (SELECT *, vr / (0.1::DOUBLE + vr) AS a, fr / (0.1::DOUBLE + fr) AS b FROM e)
    SELECT strategy_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, strategy_id) AS INTEGER) AS rank FROM (SELECT strategy_id, 0.3::DOUBLE * (2 * a * b / (a + b)) + 0.2::DOUBLE * (1 - least(greatest(vd, fd) / 0.08::DOUBLE, 1)) + 0.2::DOUBLE * (((vp - 1) / vp + (fp - 1) / fp) / 2) + 0.2::DOUBLE * wf + 0.1::DOUBLE * (1 - greatest(vs, fs)) AS score FROM q)""")
def l3_survivor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = t.read(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 50").select(
        F.col("p_partkey").alias("strategy_id"), (size / 100.0).alias("validation_return"), ((51 - size) / 100.0).alias("final_return"), (size / 1000.0).alias("validation_drawdown"), F.lit(0.02).alias("final_drawdown"),
        (1 + size / 50.0).alias("validation_profit_factor"), F.lit(2.0).alias("final_profit_factor"), F.lit(0.1).alias("validation_sensitivity"), (size / 100.0).alias("final_sensitivity"), F.lit(0.8).alias("wf_share"),
    )
    return gates.survivor_scores(rows).select("strategy_id", F.round("score", 6).alias("score"), "rank")


def _spread_sql(budget: int) -> str:
    """The greedy choice unrolled: a step for each row after the first, the farthest from those chosen, then the least."""
    pool = "SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS hypothesis_id, p_partkey AS variant_rank, p_size::DOUBLE AS a, p_retailprice FROM part"
    scaled = "SELECT *, row_number() OVER w AS r, (a - min(a) OVER h) / coalesce(nullif(max(a) OVER h - min(a) OVER h, 0), 1) AS x, (p_retailprice - min(p_retailprice) OVER h) / coalesce(nullif(max(p_retailprice) OVER h - min(p_retailprice) OVER h, 0), 1) AS y FROM pool WINDOW h AS (PARTITION BY hypothesis_id), w AS (PARTITION BY hypothesis_id ORDER BY a, p_retailprice)"
    steps = ["c0 AS (SELECT hypothesis_id, r, x, y FROM s WHERE r = 1)", "n0 AS MATERIALIZED (SELECT s.*, abs(s.x - c.x) + abs(s.y - c.y) AS near, s.r = c.r AS chosen FROM s JOIN c0 c USING (hypothesis_id))"]
    for k in range(1, budget):
        steps.append(f"c{k} AS (SELECT hypothesis_id, r, x, y FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY near DESC, r) AS o FROM n{k - 1} WHERE NOT chosen) WHERE o = 1)")
        steps.append(f"n{k} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN c.r IS NULL THEN n.near ELSE least(n.near, abs(n.x - c.x) + abs(n.y - c.y)) END AS near, n.chosen OR coalesce(n.r = c.r, false) AS chosen) FROM n{k - 1} n LEFT JOIN c{k} c USING (hypothesis_id))")
    return f"WITH pool AS ({pool}), s AS MATERIALIZED ({scaled}), {', '.join(steps)} SELECT hypothesis_id, variant_rank, a, p_retailprice FROM n{budget - 1} WHERE chosen"


@query(_spread_sql(8))
def l9_spread_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("hypothesis_id"), F.col("p_partkey").alias("variant_rank"), F.col("p_size").cast("double").alias("a"), "p_retailprice")
    return gates.farthest_points(parts, 8)


@query("""SELECT p_brand AS hypothesis_id, p_partkey, CASE WHEN p_size < 5 THEN 'BELOW_MINIMUM' WHEN p_size > 45 THEN 'ABOVE_MAXIMUM' END AS code FROM part WHERE p_size < 5 OR p_size > 45""")
def l11_range_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = 5, 45
    code = F.when(F.col("p_size") < low, "BELOW_MINIMUM").when(F.col("p_size") > high, "ABOVE_MAXIMUM")
    return t.read(spark, sf_dir, "part").select(F.col("p_brand").alias("hypothesis_id"), "p_partkey", code.alias("code")).where("code IS NOT NULL")


@query("""WITH a AS (SELECT date_trunc('hour', ts) AS h, median(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS h, median(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT h AS hour, round((b.v - a.v) / nullif(a.v, 0) * 10000, 4) AS difference_bps FROM a JOIN b USING (h)""")
def s10_provider_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value", (F.col("event_id") % 2).alias("feed"))
    both = events.groupBy("hour").agg(F.median(F.when(F.col("feed") == 0, F.col("value"))).alias("a"), F.median(F.when(F.col("feed") == 1, F.col("value"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("hour", F.round((F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)) * 10000, 4).alias("difference_bps"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, scenario, round(l_extendedprice * (1 + bps / 10000), 6) AS paid FROM lineitem, (VALUES ('optimistic', 1.0::DOUBLE), ('base', 3.0::DOUBLE), ('stress', 7.0::DOUBLE)) c(scenario, bps)""")
def f4_market_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.with_scenarios(t.read(spark, sf_dir, "lineitem"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "scenario", F.round(trades.market_price(F.col("l_extendedprice"), F.lit("buy"), F.col("impact_bps")), 6).alias("paid"))


@query("""SELECT o_orderkey, "check" FROM (SELECT o_orderkey, unnest([CASE WHEN NOT coalesce(n <= 7, false) THEN 'few_lines' END, CASE WHEN NOT coalesce(lowest > 0, false) THEN 'positive_price' END]) AS "check"
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_extendedprice) AS lowest FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) WHERE "check" IS NOT NULL""")
def v4_evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lowest"))
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return evidence.offending(rows, {"few_lines": "n <= 7", "positive_price": "lowest > 0"}, "o_orderkey")
