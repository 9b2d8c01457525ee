"""The driver's tables in the roles of FIXTURES.md, as DataFrames and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import calendars, features
from tickloom.sources import bars as sources

FIRST, LAST = "2024-01-01", "2024-01-30"

TICKS = "SELECT event_type AS symbol, ts, value AS price, event_id, CAST(ts AS DATE) AS session_date, user_id, props FROM events"


def bars_sql(minutes: int = 60) -> str:
    return f"""SELECT symbol, session_date, CAST((hour(ts) * 60 + minute(ts)) // {minutes} AS INTEGER) AS slot,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
        count(*) AS volume, session_date + to_minutes(CAST({minutes} * ((hour(ts) * 60 + minute(ts)) // {minutes}) AS BIGINT)) AS bar_start
        FROM ({TICKS}) GROUP BY symbol, session_date, (hour(ts) * 60 + minute(ts)) // {minutes}"""


GRID = f"SELECT d::DATE AS session_date, CAST(h AS INTEGER) AS slot, d + to_hours(h) AS bar_start FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY) t(d), range(24) r(h)"

FEATURES = f"""
    SELECT symbol, session_date, slot, open, high, low, close, volume, bar_start,
        close / nullif(b1, 0) - 1 AS return_1, close / nullif(b3, 0) - 1 AS return_3,
        CASE WHEN len(cs) >= 8 THEN list_reduce(cs, lambda a, x: a * (1.0::DOUBLE - 2.0::DOUBLE / 4) + x * (2.0::DOUBLE / 4)) / nullif(list_reduce(cs, lambda a, x: a * (1.0::DOUBLE - 2.0::DOUBLE / 9) + x * (2.0::DOUBLE / 9)), 0) - 1 END AS ema_spread,
        CASE WHEN gain = 0 AND loss = 0 THEN 50.0::DOUBLE WHEN gain > 0 AND loss = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1 + gain / nullif(loss, 0)) END AS rsi,
        atr / nullif(close, 0) * 10000 AS atr_bps, volume / nullif(mv, 0) AS volume_ratio, (close / nullif(pv / nullif(vv, 0), 0) - 1) * 10000 AS vwap_distance_bps,
        CASE WHEN high = low AND close = high THEN 0.5::DOUBLE ELSE (close - low) / nullif(high - low, 0) END AS range_position
    FROM (SELECT *, CASE WHEN count(ch) OVER l14 = 14 THEN avg(greatest(ch, 0)) FILTER (WHERE ch IS NOT NULL) OVER l14 END AS gain,
            CASE WHEN count(ch) OVER l14 = 14 THEN avg(-least(ch, 0)) FILTER (WHERE ch IS NOT NULL) OVER l14 END AS loss,
            CASE WHEN count(tr) OVER l14 = 14 THEN avg(tr) OVER l14 END AS atr, CASE WHEN count(volume) OVER l20 = 20 THEN avg(volume) OVER l20 END AS mv,
            sum((high + low + close) / 3.0::DOUBLE * volume) OVER u AS pv, sum(volume) OVER u AS vv, list(close) OVER u AS cs
        FROM (SELECT *, lag(close) OVER w AS b1, lag(close, 3) OVER w AS b3, close - lag(close) OVER w AS ch, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
            FROM ({bars_sql()}) WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot))
        WINDOW l14 AS (PARTITION BY symbol, session_date ORDER BY slot ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
            l20 AS (PARTITION BY symbol, session_date ORDER BY slot ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
            u AS (PARTITION BY symbol, session_date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

#: Lines as trades: a strategy is an order priority, a symbol a return flag, a session a shipping date.
TRADES = """SELECT o_orderpriority AS strategy_id, l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS session_date, l_quantity AS quantity, l_extendedprice AS notional,
        CAST(round((l_discount - 0.05) * l_extendedprice, 4) AS DECIMAL(18,4)) AS net_pnl, CAST(round(l_tax * l_extendedprice, 4) AS DECIMAL(18,4)) AS cost_paid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one of a session on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new folder and read it back, so what follows reads it as often as it needs and no lost executor costs its lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key over as many tasks as shuffles have, for costly work on each: a short file would be read, and worked on, by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.ticks_from_events(read(spark, sf_dir, "events"))


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    return sources.bars_from_ticks(ticks(spark, sf_dir), minutes)


def calendar(spark: SparkSession) -> DataFrame:
    return calendars.continuous(spark, FIRST, LAST)


def grid(spark: SparkSession) -> DataFrame:
    return calendars.grid(calendar(spark), 60)


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_frame(bars(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    money = lambda x: F.round(x, 4).cast("decimal(18,4)")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderpriority").alias("strategy_id"), F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("session_date"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("notional"), money((F.col("l_discount") - 0.05) * F.col("l_extendedprice")).alias("net_pnl"), money(F.col("l_tax") * F.col("l_extendedprice")).alias("cost_paid"),
    )
