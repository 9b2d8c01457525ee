"""Queries over snapshots that were tampered with, and replays that resume from a stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import calendars, features, quality, snapshots
from tickloom.plans import tables as t
from tickloom.plans.bar_queries import _QUALITY
from tickloom.plans.registry import query

#: What is changed after publishing: a price in one symbol's third slots, and sessions that lose their last hours.
_LOST = "symbol = 'click' AND slot >= 20"
_MOVED = "symbol = 'view' AND slot = 3"


def _manifest_sql(bars: str) -> str:
    cents = ", '|', ".join(f"CAST(round({c} * 1000000) AS BIGINT)" for c in ("open", "high", "low", "close"))
    return f"""SELECT symbol, session_date, CAST(count(*) AS VARCHAR) AS rows, CAST(CAST(min(epoch(bar_start)) AS BIGINT) AS VARCHAR) AS first_start, CAST(CAST(max(epoch(bar_start)) AS BIGINT) AS VARCHAR) AS last_start, CAST(sum(volume) AS VARCHAR) AS volume,
        CAST(sum(CAST('0x' || substr(md5(concat(CAST(epoch(bar_start) AS BIGINT), '|', {cents}, '|', volume)), 1, 10) AS BIGINT)) AS VARCHAR) AS content FROM ({bars}) GROUP BY ALL"""


_TAMPERED = f"SELECT * REPLACE (CASE WHEN {_MOVED} THEN close + 1 ELSE close END AS close) FROM ({t.bars_sql()}) WHERE NOT ({_LOST})"
_FIELDS = ("rows", "first_start", "last_start", "volume", "content")


def _quality_sql(bars: str) -> str:
    return _QUALITY.replace(t.bars_sql(), bars)


_COUNTS = ("observed", "invalid_ohlc_rows", "missing")


@query(f"""WITH a AS ({_manifest_sql(t.bars_sql())}), b AS ({_manifest_sql(_TAMPERED)}), p AS ({_quality_sql(t.bars_sql())}), q AS ({_quality_sql(_TAMPERED)})
    {" UNION ALL ".join(f"SELECT 'manifest' AS part, a.symbol || '|' || a.session_date AS key, '{f}' AS field, a.{f} AS published, b.{f} AS found FROM a JOIN b USING (symbol, session_date) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS)}
    UNION ALL SELECT 'manifest', coalesce(a.symbol, b.symbol) || '|' || coalesce(a.session_date, b.session_date), 'present', CAST(a.symbol IS NOT NULL AS VARCHAR), CAST(b.symbol IS NOT NULL AS VARCHAR) FROM a FULL JOIN b ON a.symbol = b.symbol AND a.session_date = b.session_date WHERE a.symbol IS NULL OR b.symbol IS NULL
    UNION ALL {" UNION ALL ".join(f"SELECT 'quality', p.symbol || '|' || p.session_date, '{f}', CAST(p.{f} AS VARCHAR), CAST(q.{f} AS VARCHAR) FROM p JOIN q USING (symbol, session_date) WHERE p.{f} IS DISTINCT FROM q.{f}" for f in _COUNTS)}""")
def j18_snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars are published, their data is replaced by other data, and the check names each field of the manifest and of the quality that no longer
    holds. (Names of files differ from run to run; tests look at those.)"""
    bars = t.bars(spark, sf_dir)
    expected = t.stored(calendars.expected_groups(bars, t.calendar(spark)), "expected")
    assess = lambda df: quality.assess(df, t.grid(spark), expected).select("symbol", "session_date", *_COUNTS)
    path = t.folder(spark, "snapshot")
    snapshots.publish(bars, path, assess(bars))
    close = F.when(F.expr(_MOVED), F.col("close") + 1).otherwise(F.col("close"))
    bars.withColumn("close", close).where(f"NOT ({_LOST})").repartition("session_date").write.mode("overwrite").partitionBy("session_date").parquet(f"{path}/data")
    return snapshots.check(spark, path, bars.schema, assess).where("part <> 'files'")


@query(f"""SELECT symbol, CAST(session_date AS VARCHAR) AS session, block, side FROM (
    SELECT symbol, session_date, CAST(slot // 4 AS INTEGER) AS block, 'left' AS side FROM ({t.bars_sql()}) WHERE slot % 4 = 0 AND symbol = 'view' AND false
    UNION ALL SELECT symbol, session_date, CAST(slot // 4 AS INTEGER), unnest(['left', 'right']) FROM ({t.bars_sql()}) WHERE symbol = 'view' GROUP BY symbol, session_date, slot // 4 HAVING count(*) = 4 AND max(high) > 150)""")
def j2_derived_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published four-hour bars against those that the hourly ones give: one symbol's high ones were published with another high."""
    from tickloom.operators.evidence import difference

    found = features.resample(t.bars(spark, sf_dir), 4).select("symbol", "session_date", "block", "open", "high", "low", "close", "volume")
    published = t.stored(found.withColumn("high", F.when((F.col("symbol") == "view") & (F.col("high") > 150), F.col("high") + 1).otherwise(F.col("high"))), "derived")
    return difference(published, found).select("symbol", F.col("session_date").cast("string").alias("session"), "block", "side")


_HOW = {"entity": "user_id", "time": "ts", "tie": "event_id", "payload": "event_type"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log partitioned by day."""
    path = t.folder(spark, "log")
    t.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")).repartition("day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id AS entity, last(event_type ORDER BY ts, event_id) AS payload, count(*) AS events FROM events GROUP BY user_id")
def j7_resumed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events, from a stored state of the first half of the month and the days after it."""
    log, path = _log(spark, sf_dir), t.folder(spark, "state")
    snapshots.save_state(snapshots.replay_state(log.where("day <= '2024-01-15'"), **_HOW), path, "2024-01-15")
    return snapshots.resumed(spark, path, log, "day", **_HOW).select("entity", F.col("last.payload").alias("payload"), "events")


@query("""SELECT CAST(user_id AS VARCHAR) AS entity, 'events' AS field, CAST(count(*) + 1 AS VARCHAR) AS published, CAST(count(*) AS VARCHAR) AS found FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE CAST(ts AS DATE) <= DATE '2024-01-15' AND event_type = 'error') >= 4""")
def j7_forged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored state that counts an event too many for users of four errors and more is found by a clean replay."""
    log, path = _log(spark, sf_dir), t.folder(spark, "state")
    first = log.where("day <= '2024-01-15'")
    errors = first.groupBy(F.col("user_id").alias("entity")).agg((F.count_if(F.col("event_type") == "error") >= 4).cast("long").alias("more"))
    state = snapshots.replay_state(first, **_HOW).join(errors, "entity").withColumn("events", F.col("events") + F.col("more")).drop("more")
    snapshots.save_state(state, path, "2024-01-15")
    return snapshots.state_faults(snapshots.resumed(spark, path, log, "day", **_HOW), snapshots.replay_state(log, **_HOW))
