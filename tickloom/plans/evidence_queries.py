"""Queries over logs and datasets: differences, hashes, reconciliation, replay, life cycles, checks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import evidence
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.plans.trade_queries import CASH, _DAILY, daily_equity  # noqa: F401

# The steps of a life cycle that are allowed between event types.
ALLOWED = [("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("view", "signup")]
_ALLOWED = ", ".join(f"('{a}>{b}')" for a, b in ALLOWED)


@query("""SELECT o_orderkey, o_orderstatus, side FROM (
    SELECT *, 'left' AS side FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END FROM orders)
    UNION ALL SELECT *, 'right' FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders))""")
def j1_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return evidence.difference(orders, changed)


@query("SELECT p_partkey, sha256(length(p_brand) || ':' || p_brand || '|' || length(p_name) || ':' || p_name || '|' || length(p_partkey::VARCHAR) || ':' || p_partkey) AS row_sha256 FROM part")
def j3_row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "part").select("p_partkey", evidence.row_hash("p_partkey", "p_name", "p_brand").alias("row_sha256"))


@query("""WITH h AS (SELECT sha256(length(text) || ':' || text) AS h FROM documents),
    d AS (SELECT CAST('0x' || substr(h, 1, 2) AS INTEGER) AS bucket, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS w0, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS w1, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS w2, sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS w3 FROM h GROUP BY 1)
    SELECT sha256(string_agg(x, '|' ORDER BY x)) AS content_sha256, CAST(sum(n) AS BIGINT) AS row_count FROM (SELECT bucket || ':' || n || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3 AS x, n FROM d)""")
def j3_dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dataset_hash(t.read(spark, sf_dir, "documents"), "text")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def j4_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest(t.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS total, o_orderstatus AS status FROM orders),
    b AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 AS BIGINT) AS total, max(l_linestatus) AS status FROM lineitem GROUP BY 1)
    SELECT o_orderkey, codes FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'UNKNOWN_AT_LOCAL' WHEN b.o_orderkey IS NULL THEN 'MISSING_AT_BROKER'
        ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'STATUS_MISMATCH' END, CASE WHEN a.total IS DISTINCT FROM b.total THEN 'TOTAL_MISMATCH' END) END AS codes FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE codes <> ''""".replace("CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 AS BIGINT)", "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100 AS BIGINT)"))
def j5_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = t.read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("total"), F.col("o_orderstatus").alias("status"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    broker = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.floor(cents / 100).alias("total"), F.max("l_linestatus").alias("status"))
    return evidence.reconcile(local, broker, "o_orderkey", ["total", "status"])


@query("""SELECT user_id AS entity, last(event_type ORDER BY ts, event_type, event_id) AS payload, max(ts) AS last_time, count(DISTINCT event_id) AS events FROM events GROUP BY user_id""")
def j6_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.read(spark, sf_dir, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of log kinds
    return evidence.replay({k: events.where(F.col("event_type") == k) for k in kinds}, "user_id", "ts", "event_id", "event_type")


@query(f"""SELECT event_id, from_state, event_type, from_state IS NULL OR concat(from_state, '>', event_type) IN (SELECT x FROM (VALUES {_ALLOWED}) v(x)) AS legal
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state FROM events)""")
def j8_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.transitions(t.read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ALLOWED).select("event_id", "from_state", "event_type", "legal")


@query("SELECT event_type AS state, count(*) AS users FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE r = 1 GROUP BY 1")
def j9_states_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.read(spark, sf_dir, "events").where("ts <= TIMESTAMP_NTZ'2024-01-20'")
    return log.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state")).groupBy("state").agg(F.count("*").alias("users"))


@query("SELECT o_orderkey, 'po_' || rtrim(translate(to_base64(unhex(sha256(o_orderkey || '|' || o_orderstatus))), '+/', '-_'), '=') AS order_key FROM orders")
def j13_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "orders").select("o_orderkey", evidence.order_key("o_orderkey", "o_orderstatus").alias("order_key"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey::VARCHAR) AS own, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT o_custkey, o_orderkey FROM s WHERE i > 1 AND before % 11 = 0""")
def j15_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_orderkey").over(w)
    stages = t.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("i"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("own"), F.when(before % 11 == 0, "forged").otherwise(F.sha2(before.cast("string"), 256)).alias("previous"))
    return evidence.chain_breaks(stages, "o_custkey", "i", "own", "previous").select("o_custkey", "o_orderkey")


@query("""SELECT action, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'append' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'skip' END AS action FROM orders) GROUP BY 1""")
def a14_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.read(spark, sf_dir, "orders").select("o_orderkey", F.sha2("o_orderstatus", 256).alias("content"))
    old = orders.where("o_orderkey % 3 <> 0").withColumn("content", F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("content")))
    return evidence.append_plan(old, orders, "o_orderkey", "content").groupBy("action").agg(F.count("*").alias("rows"))


@query("SELECT user_id, event_id AS last_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def a15_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.read(spark, sf_dir, "events").select("user_id", "event_id")
    early, late = log.where("event_id % 2 = 0"), log.where("event_id % 2 = 1")
    state = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    newer = state(late).join(state(early).withColumnRenamed("last_event", "old"), "user_id", "left").where("old IS NULL OR last_event > old").drop("old")
    return evidence.upsert(state(early), newer, "user_id")


@query("""SELECT o_orderkey, "check" FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END]) AS "check" FROM orders) WHERE "check" IS NOT NULL""")
def v1_offending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.offending(t.read(spark, sf_dir, "orders"), {"price": "o_totalprice > 1000", "status": "o_orderstatus IN ('F', 'O')"}, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v3_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators.features import repeated_keys

    return repeated_keys(t.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""SELECT strategy_id, session_date, CAST(pnl AS DOUBLE) AS pnl, CAST(total AS DOUBLE) AS cumulative, CAST(greatest(0, max(total) OVER w) - total AS DOUBLE) AS drawdown
    FROM (SELECT *, sum(pnl) OVER (PARTITION BY strategy_id ORDER BY session_date) AS total FROM ({_DAILY})) WINDOW w AS (PARTITION BY strategy_id ORDER BY session_date)""")
def r1_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = t.trades(spark, sf_dir).groupBy("strategy_id", "session_date").agg(F.sum("net_pnl").alias("pnl"))
    w = Window.partitionBy("strategy_id").orderBy("session_date")
    rows = daily.withColumn("total", F.sum("pnl").over(w))
    peak = F.greatest(F.max("total").over(w), F.lit(0))
    return rows.select("strategy_id", "session_date", F.col("pnl").cast("double").alias("pnl"), F.col("total").cast("double").alias("cumulative"), (peak - F.col("total")).cast("double").alias("drawdown"))


@query("""SELECT p_brand, count(DISTINCT l_orderkey) AS orders, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS return_rate
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def r4_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("orders"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 9).alias("return_rate"))
