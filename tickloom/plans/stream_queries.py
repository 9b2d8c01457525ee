"""Queries that run as streams over what is there now, into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import tables as t
from tickloom.plans.bar_queries import RULES
from tickloom.plans.registry import query, sql_of
from tickloom.plans.tables import folder
from tickloom.streaming import bars as streams
from tickloom.streaming import sessions


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_events(spark, f"{sf_dir}/events.parquet")


@query("""SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)""")
def s1_streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.bars(events(spark, sf_dir)), folder(spark, "bars"))
    return out.select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume")


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS bar_start, count(*) AS volume FROM events GROUP BY 1, 2
    HAVING count(DISTINCT hour(ts)) = 4 AND time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)""")
def s1_streamed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.complete_blocks(events(spark, sf_dir), 60, 4), folder(spark, "blocks"))
    return out.select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "volume")


@query("SELECT event_type AS symbol, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def s2_streamed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    out = streams.run_available(streams.deduplicated(rows.unionByName(rows), ["event_id"]), folder(spark, "distinct"))
    return out.groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"""SELECT symbol, CAST(epoch(session_date + to_hours(CAST(block * 4 AS BIGINT))) AS BIGINT) AS t, close, CAST(volume AS BIGINT) AS volume FROM
    (SELECT symbol, session_date, slot // 4 AS block, last(close ORDER BY slot) AS close, sum(volume) AS volume FROM ({t.bars_sql()}) GROUP BY ALL HAVING count(*) = 4)""")
def s6_stateful_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, [_slots(spark, sf_dir)], 40 * 86_400).where("kind = 'block'").select("symbol", "t", "close", "volume")


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).select("symbol", F.unix_timestamp("bar_start").alias("t"), "close", "volume")


def _runs(spark: SparkSession, parts: list[DataFrame], transform, silence_s: float | None = None) -> DataFrame:
    """What a stateful stream gives for rows (with t, in seconds) that arrive part after part, each in a run of its own from the same checkpoint.
    silence_s: the stream has a processing-time clock and runs on for so long."""
    where, at = folder(spark, "slots"), folder(spark, "state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            part.repartitionByRange("t").sortWithinPartitions("t").write.mode("append").parquet(where)
            stream = transform(spark.readStream.schema(part.schema).parquet(where))
            out = streams.run_available(stream, at) if silence_s is None else streams.run_until_silent(stream, at, silence_s)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out


def _states(spark: SparkSession, parts: list[DataFrame], late_s: int) -> DataFrame:
    """What the keyed state gives for bars that arrive part after part."""
    return _runs(spark, parts, lambda stream: streams.stateful_blocks(stream, 3600, 4, late_s))


_SLOTS = f"SELECT symbol, CAST(epoch(bar_start) AS BIGINT) AS t, close, CAST(volume AS BIGINT) AS volume FROM ({t.bars_sql()})"


@query(f"SELECT symbol, t, close + 1 AS close, volume FROM ({_SLOTS}) WHERE t // 3600 % 5 = 0")
def s2_conflicting_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _slots(spark, sf_dir)
    changed = bars.where(F.floor(F.col("t") / 3600) % 5 == 0).withColumn("close", F.col("close") + 1)
    out = _states(spark, [bars.unionByName(bars.where("volume % 2 = 0")).unionByName(changed)], 40 * 86_400)
    return out.where("kind = 'conflict'").select("symbol", "t", "close", "volume")


@query(f"WITH s AS ({_SLOTS}) SELECT symbol, t, close, volume FROM s WHERE t // 86400 % 2 = 0 AND t < (SELECT max(o.t) FROM s o WHERE o.symbol = s.symbol AND o.t // 86400 % 2 = 1) - 7 * 86400")
def s3_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, odd = _slots(spark, sf_dir), F.floor(F.col("t") / 86_400) % 2 == 1
    return _states(spark, [bars.where(odd), bars.where(~odd)], 7 * 86_400).where("kind = 'late'").select("symbol", "t", "close", "volume")


@query("SELECT event_id, event_type AS symbol FROM events WHERE hour(ts) < 2 OR hour(ts) >= 22")
def s4_outside_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    inside = t.grid(spark).where("slot BETWEEN 2 AND 21").select("session_date", "slot")
    keyed = rows.withColumn("session_date", F.to_date("ts")).withColumn("slot", F.hour("ts"))
    outside = keyed.join(F.broadcast(inside), ["session_date", "slot"], "left_anti")  # the grid of a calendar
    return streams.run_available(outside.select("event_id", "symbol"), folder(spark, "outside"))


@query("SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS usable_at FROM events WHERE value > 100")
def s8_signals_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal is usable a minute after its minute, once for each symbol and time."""
    rows = events(spark, sf_dir)
    usable = F.date_trunc("minute", "ts") + F.expr("INTERVAL 1 MINUTE")
    signals = rows.unionByName(rows).where("price > 100").select("symbol", "ts", usable.alias("usable_at"))
    out = streams.run_available(streams.deduplicated(signals, ["symbol", "usable_at"]), folder(spark, "signals"))
    return out.select("symbol", F.col("usable_at").cast("timestamp_ntz").alias("usable_at"))


@query("""SELECT symbol, CAST(session_date AS VARCHAR) AS day, CAST(coalesce(count(*) FILTER (WHERE gap > 1800), 0) AS BIGINT) AS gaps, CAST(coalesce(max(gap), 0) AS BIGINT) AS longest
    FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, CAST(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS BIGINT) AS gap FROM events) GROUP BY ALL""")
def s5_feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.feed_health(t.ticks(spark, sf_dir), 1800).select("symbol", F.col("session_date").cast("string").alias("day"), "gaps", "longest")


@query("SELECT event_type AS symbol, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def s11_idempotent_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then all of them twice by another stream: each is in the sink once."""
    where, rows = folder(spark, "sink"), events(spark, sf_dir).select("event_id", "symbol", "price")
    streams.append_new(rows.where("event_id % 2 = 0"), where, folder(spark, "half"), ["event_id"])
    streams.append_new(rows.unionByName(rows), where, folder(spark, "all"), ["event_id"])
    return spark.read.parquet(where).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_COOL, _MOST = 3600, 2
_KINDS = {"signup": "enter", "purchase": "fill", "click": "exit", "error": "reject"}


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY t, n) AS i, count(*) OVER (PARTITION BY symbol, session) AS many FROM
        (SELECT 'u' || user_id AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS n, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS event FROM events WHERE event_type <> 'view')),
    s AS (SELECT DISTINCT symbol, session, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, '' AS event, false AS elapsed, CAST(0 AS BIGINT) AS was_until, 0 AS was_entries, 'FLAT' AS from_phase, CAST(NULL AS VARCHAR) AS to_phase, 'FLAT' AS phase, 0 AS entries, CAST(0 AS BIGINT) AS until FROM o
        UNION ALL
        SELECT symbol, session, i, t, event, elapsed, until, entries, p, q, coalesce(q, p), entries + CASE WHEN q = 'LONG' AND p = 'ENTRY_PENDING' THEN 1 ELSE 0 END, CASE WHEN q = 'COOLDOWN' THEN t + {_COOL} ELSE until END
        FROM (SELECT *, CASE WHEN event = 'enter' AND p = 'FLAT' AND entries < {_MOST} THEN 'ENTRY_PENDING' WHEN event = 'fill' AND p = 'ENTRY_PENDING' THEN 'LONG' WHEN event = 'fill' AND p = 'EXIT_PENDING' THEN 'COOLDOWN' WHEN event = 'exit' AND p = 'LONG' THEN 'EXIT_PENDING'
                WHEN event = 'reject' AND p = 'ENTRY_PENDING' THEN 'FLAT' WHEN event = 'reject' AND p = 'EXIT_PENDING' THEN 'LONG' END AS q
              FROM (SELECT o.symbol, o.session, o.i, o.t, o.event, s.phase = 'COOLDOWN' AND o.t >= s.until AS elapsed, s.until, s.entries, CASE WHEN s.phase = 'COOLDOWN' AND o.t >= s.until THEN 'FLAT' ELSE s.phase END AS p
                    FROM s JOIN o ON o.symbol = s.symbol AND o.session = s.session AND o.i = s.i + 1))),
    w AS (SELECT epoch_ms(max(ts)) / 1000.0 AS w FROM events WHERE event_type <> 'view'),
    z AS (SELECT s.*, CAST(epoch(CAST(session AS DATE)) AS BIGINT) + 86400 AS ends FROM s JOIN (SELECT DISTINCT symbol, session, many FROM o) USING (symbol, session) WHERE i = many),
    c AS (SELECT *, phase = 'COOLDOWN' AND until <= (SELECT w FROM w) AND until <= ends AS over FROM z)
    SELECT 'paper' AS strategy_id, symbol, session, t, event, outcome, from_phase, to_phase, CAST(entries AS INTEGER) AS entries FROM (
        SELECT symbol, session, was_until AS t, 'cooldown_elapsed' AS event, 'accepted' AS outcome, 'COOLDOWN' AS from_phase, 'FLAT' AS to_phase, was_entries AS entries FROM s WHERE elapsed
        UNION ALL SELECT symbol, session, t, event, CASE WHEN to_phase IS NULL THEN 'refused' ELSE 'accepted' END, from_phase, coalesce(to_phase, from_phase), entries FROM s WHERE i > 0
        UNION ALL SELECT symbol, session, until, 'cooldown_elapsed', 'accepted', 'COOLDOWN', 'FLAT', entries FROM c WHERE over
        UNION ALL SELECT symbol, session, ends, 'session_end', 'accepted', CASE WHEN over THEN 'FLAT' ELSE phase END, 'SESSION_CLOSED', entries FROM c WHERE ends <= (SELECT w FROM w))""")
def s9_strategy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases, cooldowns and entry counts of a strategy for each user and day, its events in three runs of ten days each."""
    rows = t.read(spark, sf_dir, "events").where("event_type <> 'view'")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type"))
    ts = F.col("ts").cast("timestamp")
    rows = rows.select(F.lit("paper").alias("strategy_id"), F.concat(F.lit("u"), "user_id").alias("symbol"), F.to_date(ts).cast("string").alias("session"), ts.alias("ts"), F.unix_timestamp(ts).alias("t"), F.col("event_id").alias("n"), kind.alias("event"))
    day = F.dayofmonth("ts")
    parts = [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]
    return _runs(spark, parts, lambda stream: sessions.strategy_states(stream, _COOL, _MOST))


@query(f"SELECT strategy_id, symbol, session_date AS session, slot FROM ({sql_of('g4_rule_signals')})")
def s7_streamed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' signals from a stream of bars, a third of every session's bars in each run."""
    bars = t.bars(spark, sf_dir).select("symbol", F.col("session_date").cast("string").alias("session"), F.unix_timestamp("bar_start").alias("t"), "slot", "high", "low", "close", "volume")
    third = F.floor(F.col("slot") / 8)
    return _runs(spark, [bars.where(third == i) for i in range(3)], lambda stream: sessions.signals(stream, RULES))


@query("""WITH m AS (SELECT DISTINCT event_type AS symbol, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS t FROM events)
    SELECT symbol, 'MARKET_DATA_STALE' AS code FROM m GROUP BY 1 UNION ALL SELECT 'absent', 'REQUIRED_SYMBOL_STREAM_MISSING'
    UNION ALL SELECT symbol, 'MARKET_DATA_GAP' FROM (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM m) GROUP BY 1 HAVING max(gap) > 7200""")
def s5_feed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of every symbol's feed and of one that never comes, once the feeds have been silent for a second."""
    rows = t.ticks(spark, sf_dir).select("symbol", F.unix_timestamp(F.date_trunc("minute", "ts")).alias("t")).distinct()
    required = rows.select("symbol").distinct().unionByName(spark.createDataFrame([("absent",)], "symbol string"))
    return _runs(spark, [rows], lambda stream: sessions.feed_codes(stream, required, 7200, 1000), silence_s=1.5)


@query("""SELECT symbol, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(*) FILTER (WHERE event_id % 7 = 0) AS conflicts FROM (SELECT event_type AS symbol, event_id FROM events) GROUP BY 1""")
def s11_checked_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then all of them twice, then some with another price, by three streams: each event is in the sink once, as it first
    came, and each other price among the conflicts."""
    where, rows = folder(spark, "sink"), events(spark, sf_dir).select("event_id", "symbol", "price", F.col("session_date").cast("string").alias("day"))
    for part in (rows.where("event_id % 2 = 0"), rows.unionByName(rows), rows.where("event_id % 7 = 0").withColumn("price", F.col("price") + 1)):
        sessions.append_checked(part, where, folder(spark, "deliveries"), ["event_id"], "day", 1)
    kept = sessions.read_sink(spark, where, rows.schema).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    odd = sessions.read_sink(spark, where, rows.schema, "conflicts").groupBy("symbol").agg(F.count("*").alias("conflicts"))
    return kept.join(odd, "symbol", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
