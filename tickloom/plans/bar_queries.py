"""Queries over ticks and bars: sources, grids, quality, resampling, features, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import calendars, features, quality, rules
from tickloom.plans import tables as t
from tickloom.plans.registry import query
from tickloom.sources import bars as sources

FEATURE_NAMES = ("return_1", "return_3", "ema_spread", "rsi", "atr_bps", "volume_ratio", "vwap_distance_bps", "range_position")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in names})


@query("SELECT count(*) AS rows, min(ts) AS first_time, max(ts) AS last_time, array_to_string(list_sort(list(DISTINCT upper(trim(event_type)))), ',') AS symbols FROM events")
def a4_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"))
    out = sources.profile(rows, F.lit("events"))
    return out.select("rows", F.col("first_time").cast("timestamp_ntz").alias("first_time"), F.col("last_time").cast("timestamp_ntz").alias("last_time"), F.array_join("symbols", ",").alias("symbols"))


@query(f"SELECT symbol, session_date, slot, open, high, low, close, volume, bar_start FROM ({t.bars_sql()})")
def e0_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).drop("available_at").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query(f"SELECT strftime(session_date, '%Y-%m-%d') AS day, count(*) AS bars, sum(volume)::BIGINT AS ticks, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM ({t.bars_sql()}) GROUP BY session_date")
def a10_manifest_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).groupBy(F.col("session_date").cast("string").alias("day")).agg(F.count("*").alias("bars"), F.sum("volume").alias("ticks"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


@query(f"""SELECT '{{"close":' || CAST(volume AS VARCHAR) || ',"session_date":"' || session_date || '","symbol":"' || symbol || '"}}' AS value FROM ({t.bars_sql()})""")
def a11_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.json_lines(t.bars(spark, sf_dir).select("symbol", "session_date", F.col("volume").alias("close")))


@query(f"SELECT symbol, session_date, slot, close FROM ({t.bars_sql()}) WHERE session_date IN (DATE '2024-01-03', DATE '2024-01-17')")
def a12_bars_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = t.calendar(spark).where("session_date IN (DATE'2024-01-03', DATE'2024-01-17')").select("session_date")
    return t.bars(spark, sf_dir).join(F.broadcast(wanted), "session_date", "left_semi").select("symbol", "session_date", "slot", "close")


@query(f"SELECT g.session_date, g.slot, g.bar_start, count(symbol) AS symbols FROM ({t.GRID}) g LEFT JOIN ({t.bars_sql()}) b USING (session_date, slot) GROUP BY ALL")
def b1_grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = t.bars(spark, sf_dir).select("session_date", "slot", "symbol")
    return t.grid(spark).join(have, ["session_date", "slot"], "left").groupBy("session_date", "slot", F.col("bar_start").cast("timestamp_ntz").alias("bar_start")).agg(F.count("symbol").alias("symbols"))


@query(f"SELECT s.symbol, g.session_date FROM (SELECT DISTINCT event_type AS symbol FROM events) s, (SELECT DISTINCT session_date FROM ({t.GRID})) g")
def b3_expected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.expected_groups(t.ticks(spark, sf_dir), t.calendar(spark))


@query("""SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE price IS NULL OR price <= 0) AS rejected FROM (SELECT upper(trim(event_type)) AS symbol, value AS price FROM events) GROUP BY symbol""")
def c1_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("value").cast("string")
    raw = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")).alias("date"), *[price.alias(c) for c in sources.PRICES], F.lit("1").alias("volume"))
    rows = sources.canonical(raw, "test", "all", "UTC")
    bad = F.col("reject").isNotNull() & (F.col("reject") != "symbol") | ~F.coalesce(sources.valid_bar(), F.lit(False))
    return rows.groupBy("symbol").agg(F.count("*").alias("rows"), F.sum(bad.cast("long")).alias("rejected"))


@query("""SELECT symbol, session_date, CAST(min(gap) AS DOUBLE) / 1000000 AS min_gap, bool_and(epoch_us(ts) % 60000000 = 0) AS whole_minutes
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS gap FROM (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS session_date, ts FROM events)) GROUP BY ALL""")
def c7_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.cadence(t.ticks(spark, sf_dir), time="ts")


@query(f"SELECT DISTINCT session_date FROM ({t.bars_sql()}) WHERE session_date NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def c5_outside_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.outside_dates(t.bars(spark, sf_dir), F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))


@query("SELECT event_type AS symbol, count(*) AS visible FROM events WHERE ts + INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def c11_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.ticks(spark, sf_dir).withColumn("available_at", F.col("ts") + F.expr("interval 1 minute"))
    return features.visible(rows, F.lit("2024-01-15 12:00:00").cast("timestamp")).groupBy("symbol").agg(F.count("*").alias("visible"))


_QUALITY = f"""
    SELECT coalesce(e.symbol, o.symbol) AS symbol, coalesce(e.session_date, o.session_date) AS session_date, coalesce(observed, 0) AS observed, coalesce(duplicate_rows, 0) AS duplicate_rows,
        coalesce(invalid_ohlc_rows, 0) AS invalid_ohlc_rows, coalesce(invalid_volume_rows, 0) AS invalid_volume_rows, coalesce(outside_rows, 0) AS outside_rows,
        CASE WHEN coalesce(e.session_date, o.session_date) BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}' THEN 24 ELSE 0 END AS expected,
        CASE WHEN coalesce(e.session_date, o.session_date) BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}' THEN 24 ELSE 0 END - coalesce(on_grid, 0) AS missing
    FROM (SELECT s.symbol, g.session_date FROM (SELECT DISTINCT event_type AS symbol FROM events) s, (SELECT DISTINCT session_date FROM ({t.GRID})) g) e
    FULL JOIN (SELECT symbol, session_date, count(*) AS observed, count(*) - count(DISTINCT bar_start) AS duplicate_rows,
            count(*) FILTER (WHERE least(open, high, low, close) <= 0 OR high < greatest(open, low, close) OR low > least(open, high, close)) AS invalid_ohlc_rows,
            count(*) FILTER (WHERE volume IS NULL OR volume < 0) AS invalid_volume_rows,
            count(*) FILTER (WHERE session_date NOT BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}') AS outside_rows,
            count(DISTINCT bar_start) FILTER (WHERE session_date BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}') AS on_grid
        FROM ({t.bars_sql()}) GROUP BY symbol, session_date) o ON e.symbol = o.symbol AND e.session_date = o.session_date"""
_PASSED = "duplicate_rows = 0 AND invalid_ohlc_rows = 0 AND invalid_volume_rows = 0 AND outside_rows = 0"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    return quality.assess(bars, t.grid(spark), calendars.expected_groups(bars, t.calendar(spark)))


@query(f"SELECT symbol, session_date, observed, duplicate_rows, invalid_ohlc_rows, invalid_volume_rows, outside_rows, expected, missing, {_PASSED} AS structural_passed, {_PASSED} AND missing = 0 AS passed FROM ({_QUALITY})".replace("expected, missing,", "CAST(expected AS BIGINT) AS expected, CAST(missing AS BIGINT) AS missing,"))
def d1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, coalesce(bool_or(fell), false) AS non_monotonic
    FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) > value AS fell FROM events) GROUP BY 1, 2""")
def d6_non_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.non_monotonic(t.ticks(spark, sf_dir), "price", "event_id")


@query(f"""SELECT count(*) AS groups, sum(observed)::BIGINT AS observed, sum(duplicate_rows)::BIGINT AS duplicate_rows, sum(invalid_ohlc_rows)::BIGINT AS invalid_ohlc_rows,
    sum(invalid_volume_rows)::BIGINT AS invalid_volume_rows, sum(outside_rows)::BIGINT AS outside_rows, sum(expected)::BIGINT AS expected, sum(missing)::BIGINT AS missing,
    bool_and({_PASSED}) AS structural_passed, bool_and({_PASSED} AND missing = 0) AS passed FROM ({_QUALITY})""")
def d9_quality_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.roll_up(_quality(spark, sf_dir))


@query(f"SELECT symbol, session_date, CAST(missing AS BIGINT) AS missing FROM ({_QUALITY}) WHERE missing > 0")
def d10_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.incomplete(_quality(spark, sf_dir)).select("symbol", "session_date", "missing")


@query(f"SELECT symbol, CASE WHEN {_PASSED} AND missing = 0 THEN 'published' WHEN symbol IN ('view') THEN 'blocking' ELSE 'quarantined' END AS publication_state, count(*) AS groups FROM ({_QUALITY}) GROUP BY ALL")
def d11_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quarantine(_quality(spark, sf_dir), ["view"]).groupBy("symbol", "publication_state").agg(F.count("*").alias("groups"))


def _blocks(n: int) -> str:
    return f"""SELECT symbol, session_date, CAST(slot // {n} AS INTEGER) AS block, first(open ORDER BY slot) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY slot) AS close, sum(volume)::BIGINT AS volume
        FROM ({t.bars_sql()}) GROUP BY symbol, session_date, slot // {n} HAVING count(*) = {n} AND count(DISTINCT slot) = {n}"""


@query(_blocks(2))
def e1_resample_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.resample(t.bars(spark, sf_dir), 2).drop("bar_start", "available_at")


@query(_blocks(4))
def e1_resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.resample(t.bars(spark, sf_dir), 4).drop("bar_start", "available_at")


@query(f"SELECT symbol, session_date, slot, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in FEATURE_NAMES)} FROM ({t.FEATURES})")
def e14_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = t.feature_frame(spark, sf_dir).select("symbol", "session_date", "slot", *FEATURE_NAMES)
    return rounded(frame, *FEATURE_NAMES)


@query(f"SELECT symbol, session_date, slot, CAST((slot + 1) * 60 AS BIGINT) AS minutes_from_open FROM ({t.bars_sql()}) WHERE session_date BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}'")
def e11_minutes_from_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.minutes_from_open(t.bars(spark, sf_dir), t.calendar(spark)).select("symbol", "session_date", "slot", "minutes_from_open")


@query(f"SELECT symbol, session_date, slot FROM ({t.bars_sql()}) WHERE (slot + 1) % 4 <> 0 OR session_date NOT BETWEEN DATE '{t.FIRST}' AND DATE '{t.LAST}'")
def e13_off_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = calendars.boundaries(t.grid(spark), 4, 60)
    return features.off_boundary(t.bars(spark, sf_dir), ends).select("symbol", "session_date", "slot")


#: Rules over the feature frame, as data.
RULES = {
    "breakout": {"all": [{"indicator": "range_position", "op": "gte", "value": 0.8}, {"indicator": "return_1", "op": "gt", "value": 0.0}]},
    "calm": {"all": [{"indicator": "atr_bps", "op": "lt", "value": 9000}, {"any": [{"indicator": "rsi", "op": "lte", "value": 45}, {"indicator": "rsi", "op": "gte", "value": 55}]}]},
    "impossible": {"all": [{"indicator": "rsi", "op": "gt", "value": 70}, {"indicator": "rsi", "op": "lte", "value": 70}]},
    "pullback": {"any": [{"indicator": "vwap_distance_bps", "op": "lt", "value": -1500}, {"all": [{"indicator": "ema_spread", "op": "lt", "value": 0.0}, {"indicator": "volume_ratio", "op": "gt", "value": 1.2}]}]},
}
_FIRED = {
    "breakout": "range_position >= 0.8 AND return_1 > 0",
    "calm": "atr_bps < 9000 AND (rsi <= 45 OR rsi >= 55)",
    "impossible": "rsi > 70 AND rsi <= 70",
    "pullback": "vwap_distance_bps < -1500 OR (ema_spread < 0 AND volume_ratio > 1.2)",
}
SIGNALS = " UNION ALL ".join(f"SELECT '{k}' AS strategy_id, symbol, session_date, slot, bar_start FROM f WHERE {v}" for k, v in _FIRED.items())


@query(f"WITH f AS ({t.FEATURES}) SELECT strategy_id, symbol, session_date, slot FROM ({SIGNALS})")
def g4_rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.signals(t.feature_frame(spark, sf_dir), RULES, ("symbol", "session_date", "slot"))


@query(f"""WITH f AS ({t.FEATURES}) SELECT symbol, session_date, slot, close FROM f WHERE close > (SELECT avg(close) FROM f) AND symbol IN (SELECT symbol FROM f WHERE rsi > 60)""")
def g1_comparison_with_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = t.feature_frame(spark, sf_dir)
    hot = frame.where(rules.condition({"indicator": "rsi", "op": "gt", "value": 60})).select("symbol").distinct()
    mean = frame.agg(F.avg("close").alias("mean"))
    return frame.join(hot, "symbol", "left_semi").join(F.broadcast(mean), F.col("close") > F.col("mean")).select("symbol", "session_date", "slot", "close")
