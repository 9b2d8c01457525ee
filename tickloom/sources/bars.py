"""Bars and ticks: reading, canonical form, profiles, sinks (SURVEY A and C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "volume")])
PRICES = ("open", "high", "low", "close")
# Column names by role, in order of preference.
TIME_NAMES, SYMBOL_NAMES = ("date", "datetime", "timestamp"), ("ticker", "symbol")
OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"
SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,15}$"


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw bars from CSV files, all as text; canonical() parses and checks them."""
    return spark.read.schema(RAW).option("header", True).csv(list(paths))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files unioned by column name; a column that a file lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def role(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of the names that is a column of df, whatever its case."""
    own = {c.lower(): c for c in df.columns}
    found = next((own[n] for n in names if n in own), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return found


def require_one_schema(frames: list[DataFrame]) -> DataFrame:
    """The union of frames whose columns and types agree; otherwise an error names the first that differs."""
    first = sorted((f.name, f.dataType.simpleString()) for f in frames[0].schema)
    for i, df in enumerate(frames[1:], 1):
        if sorted((f.name, f.dataType.simpleString()) for f in df.schema) != first:
            raise ValueError(f"the schema of source {i} differs from the first")
    return reduce(DataFrame.unionByName, frames)


def profile(df: DataFrame, by: Column | None = None) -> DataFrame:
    """Rows, first and last time and normalised symbols for each file (or for `by`). Times that don't parse are left out."""
    time, symbol = F.expr(f"try_cast(`{role(df, TIME_NAMES)}` AS timestamp)"), F.upper(F.trim(F.col(role(df, SYMBOL_NAMES)).cast("string")))
    by = F.col("_metadata.file_path") if by is None else by
    return df.select(by.alias("source"), time.alias("t"), symbol.alias("s")).groupBy("source").agg(
        F.count("*").alias("rows"), F.min("t").alias("first_time"), F.max("t").alias("last_time"), F.sort_array(F.collect_set("s")).alias("symbols")
    )


def number(name: str) -> Column:
    """A finite number, or null."""
    x = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def canonical(raw: DataFrame, provider: str, feed: str, zone: str = "America/New_York") -> DataFrame:
    """Canonical bars and, in `reject`, the first reason why a row is none (null: it is one)."""
    time = F.when(F.col("date").rlike(OFFSET), F.expr("try_cast(date AS timestamp)"))
    rows = raw.select(F.upper(F.trim("ticker")).alias("symbol"), time.alias("timestamp"), *[number(c).alias(c) for c in (*PRICES, "volume")])
    bad = F.when(~F.coalesce(F.col("symbol").rlike(SYMBOL), F.lit(False)), "symbol").when(F.col("timestamp").isNull(), "timestamp")
    for c in (*PRICES, "volume"):
        bad = bad.when(F.col(c).isNull(), c)
    return rows.select("*", F.lit(provider).alias("provider"), F.lit(feed).alias("feed"), F.to_date(F.from_utc_timestamp("timestamp", zone)).alias("session_date"), bad.alias("reject"))


def valid_bar() -> Column:
    """Prices above zero, the low not above and the high not below open and close."""
    return (F.least(*PRICES) > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))


def outside_dates(bars: DataFrame, first, last) -> DataFrame:
    """Distinct session dates outside the declared range."""
    return bars.where(~F.col("session_date").between(first, last)).select("session_date").distinct()


def cadence(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "session_date"), time: str = "timestamp") -> DataFrame:
    """For each group the least positive gap in seconds, and whether all times are whole minutes."""
    from pyspark.sql import Window

    own = bars.select(*keys, F.col(time).alias("t")).distinct()
    gap = F.unix_micros("t") - F.lag(F.unix_micros("t")).over(Window.partitionBy(*keys).orderBy("t"))
    return own.select(*keys, "t", gap.alias("gap")).groupBy(*keys).agg((F.min("gap") / 1_000_000).alias("min_gap"), F.bool_and(F.unix_micros("t") % 60_000_000 == 0).alias("whole_minutes"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by bar size and session date; one sorted run for each date, not a file for each symbol."""
    bars.repartition("bar_size", "session_date").sortWithinPartitions("bar_size", "session_date", "symbol", "timestamp").write.partitionBy("bar_size", "session_date").parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in order, times as ISO-8601 with Z."""
    form = lambda f: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
    return df.select(F.to_json(F.struct(*[form(f) for f in sorted(df.schema, key=lambda f: f.name)])).alias("value"))


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Ticks: symbol, ts, price, event_id (arrival order), session_date."""
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id", F.to_date("ts").alias("session_date"), "user_id", "props")


def bars_from_ticks(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    """Bars of a number of minutes from midnight: slot, open, high, low, close, volume (ticks), bar_start, available_at."""
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("int")
    order = F.struct("ts", "event_id")
    out = ticks.groupBy("symbol", "session_date", slot.alias("slot")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    start = F.timestamp_seconds(F.unix_timestamp(F.col("session_date").cast("timestamp")) + F.col("slot") * minutes * 60)
    return out.select("*", start.alias("bar_start"), (start + F.expr(f"interval {minutes} minutes")).alias("available_at"))
