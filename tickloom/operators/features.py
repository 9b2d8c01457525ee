"""Resampling and causal features that restart with each symbol and session (SURVEY E and W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "session_date")


def resample(bars: DataFrame, n: int, position: str = "slot") -> DataFrame:
    """Bars of n slots, counted from the session's open; a bar that lacks one of its slots, or has one twice, is absent."""
    out = bars.groupBy(*KEYS, F.floor(F.col(position) / n).cast("int").alias("block")).agg(
        F.min_by("open", position).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", position).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("rows"), F.countDistinct(position).alias("slots"), F.min("bar_start").alias("bar_start"), F.max("available_at").alias("available_at"),
    )
    return out.where((F.col("rows") == n) & (F.col("slots") == n)).drop("rows", "slots")


def running_ema(closes: Column, span: int) -> Column:
    """The exponential means of an array, one for each place: the first value, then a weight of 2 / (span + 1) for each next one; null in
    places before the span-th."""
    alpha = 2.0 / (span + 1)
    start = F.struct(F.array().cast("array<double>").alias("all"), F.lit(None).cast("double").alias("last"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["last"].isNull(), x).otherwise(a["last"] * (1.0 - alpha) + x * alpha)
        return F.struct(F.array_append(a["all"], now).alias("all"), now.alias("last"))

    return F.transform(F.aggregate(closes, start, step)["all"], lambda x, i: F.when(i >= span - 1, x))


def with_emas(bars: DataFrame, order: str, **spans: int) -> DataFrame:
    """bars with a running exponential mean of the close for each name and span: each session's closes are gathered once, in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*bars.columns).alias("_bar"))))
    sessions = bars.groupBy(*KEYS).agg(rows.alias("_rows"))
    closes = F.transform("_rows", lambda r: r["_bar"]["close"].cast("double"))
    sessions = sessions.select("_rows", *[running_ema(closes, n).alias(c) for c, n in spans.items()])
    return sessions.select(F.explode(F.arrays_zip("_rows", *spans)).alias("_x")).select("_x._rows._bar.*", *[F.col(f"_x.{c}").alias(c) for c in spans])


def feature_frame(bars: DataFrame, order: str = "slot", fast: int = 3, slow: int = 8, period: int = 14, volume_period: int = 20) -> DataFrame:
    """Bars with return_1, return_3, ema_spread, rsi, atr_bps, volume_ratio, vwap_distance_bps, range_position.

    One window order serves all of them. Null while a window is short of rows, and where a divisor is zero.
    """
    w = Window.partitionBy(*KEYS).orderBy(order)
    last = lambda n: w.rowsBetween(1 - n, 0)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    close, before = F.col("close"), F.lag("close").over(w)
    steps = with_emas(bars, order, _fast=fast, _slow=slow).select(
        "*", before.alias("_before"), (close - before).alias("_change"), F.lag("close", 3).over(w).alias("_before3"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)).alias("_range"), ((F.col("high") + F.col("low") + close) / 3.0).alias("_typical"),
    )
    up = F.when(F.col("_change").isNotNull(), F.greatest("_change", F.lit(0.0)))
    down = F.when(F.col("_change").isNotNull(), -F.least("_change", F.lit(0.0)))
    full = lambda x, c, n: F.when(F.count(c).over(last(n)) == n, F.avg(x).over(last(n)))
    steps = steps.select(
        "*", full(up, "_change", period).alias("_gain"), full(down, "_change", period).alias("_loss"), full("_range", "_range", period).alias("_atr"), full("volume", "volume", volume_period).alias("_mean_volume"),
        F.sum(F.col("_typical") * F.col("volume")).over(so_far).alias("_pv"), F.sum("volume").over(so_far).alias("_v"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    rsi = F.when((F.col("_gain") == 0) & (F.col("_loss") == 0), 50.0).when((F.col("_gain") > 0) & (F.col("_loss") == 0), 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio("_gain", "_loss")))
    flat = (F.col("high") == F.col("low")) & (close == F.col("high"))
    vwap = ratio("_pv", "_v")
    features = {
        "return_1": ratio("close", "_before") - 1.0,
        "return_3": ratio("close", "_before3") - 1.0,
        "ema_spread": ratio("_fast", "_slow") - 1.0,
        "rsi": rsi,
        "atr_bps": ratio("_atr", "close") * 10_000.0,
        "volume_ratio": ratio("volume", "_mean_volume"),
        "vwap_distance_bps": (F.try_divide(close, F.nullif(vwap, F.lit(0.0))) - 1.0) * 10_000.0,
        "range_position": F.when(flat, 0.5).otherwise(F.try_divide(close - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))),
    }
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    out = steps.select(*bars.columns, *[finite(x).alias(c) for c, x in features.items()])
    return out


def minutes_from_open(frame: DataFrame, calendar: DataFrame) -> DataFrame:
    opens = F.broadcast(calendar.select("session_date", "open_utc"))
    return frame.join(opens, "session_date").withColumn("minutes_from_open", ((F.unix_timestamp("available_at") - F.unix_timestamp("open_utc")) / 60).cast("long")).drop("open_utc")


def visible(frame: DataFrame, clock) -> DataFrame:
    """Rows that are available at the clock's time."""
    return frame.where(F.col("available_at") <= F.lit(clock))


def off_boundary(bars: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Bars that don't end on a boundary of their session."""
    return bars.join(F.broadcast(boundaries), ["session_date", "available_at"], "left_anti")


def repeated_keys(bars: DataFrame, *keys: str) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
