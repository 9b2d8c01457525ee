"""Bar quality for each symbol and session, roll-up and quarantine (SURVEY D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "session_date")
COUNTS = ("observed", "duplicate_rows", "invalid_ohlc_rows", "invalid_volume_rows", "outside_rows")


def invalid_ohlc() -> Column:
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = prices[0].isNull() | prices[1].isNull() | prices[2].isNull() | prices[3].isNull()
    o, h, low, c = prices
    return missing | F.coalesce((F.least(*prices) <= 0) | (h < F.greatest(o, low, c)) | (low > F.least(o, h, c)), F.lit(False))


def assess(bars: DataFrame, grid: DataFrame, expected: DataFrame, time: str = "bar_start") -> DataFrame:
    """One row for each observed or expected group. A row off the grid is outside; missing counts grid slots without a bar."""
    bars = bars.withColumn("__t", F.col(time))
    slots = grid.select(F.col("session_date").alias("__d"), F.col("bar_start").alias("__slot"))
    on = (F.col("session_date") == F.col("__d")) & (F.col("__t") == F.col("__slot"))
    rows = bars.join(F.broadcast(slots), on, "left")  # a grid is a few rows for each day of the calendar
    observed = rows.groupBy(*KEYS).agg(
        F.count("*").alias("observed"),
        (F.count("*") - F.countDistinct("__t")).alias("duplicate_rows"),
        F.sum(invalid_ohlc().cast("long")).alias("invalid_ohlc_rows"),
        F.sum(F.coalesce(F.col("volume") < 0, F.lit(True)).cast("long")).alias("invalid_volume_rows"),
        F.sum(F.col("__slot").isNull().cast("long")).alias("outside_rows"),
        F.countDistinct("__slot").alias("on_grid"),
    )
    size = grid.groupBy("session_date").agg(F.count("*").alias("expected"))
    both = expected.select(*KEYS).distinct().join(observed, list(KEYS), "full").join(F.broadcast(size), "session_date", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = both.select(*KEYS, *[zero(c) for c in COUNTS], zero("expected"), (F.coalesce("expected", F.lit(0)) - F.coalesce("on_grid", F.lit(0))).cast("long").alias("missing"))
    sound = (F.col("duplicate_rows") == 0) & (F.col("invalid_ohlc_rows") == 0) & (F.col("invalid_volume_rows") == 0) & (F.col("outside_rows") == 0)
    return out.select("*", sound.alias("structural_passed"), (sound & (F.col("missing") == 0)).alias("passed"))


def non_monotonic(rows: DataFrame, time: str, arrival: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Groups whose times fall at some point of their arrival order; equal times are allowed."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(arrival))
    return rows.select(*keys, (before > F.col(time)).alias("fell")).groupBy(*keys).agg(F.coalesce(F.bool_or("fell"), F.lit(False)).alias("non_monotonic"))


def roll_up(groups: DataFrame) -> DataFrame:
    """One row over all groups."""
    return groups.agg(F.count("*").alias("groups"), *[F.sum(c).cast("long").alias(c) for c in (*COUNTS, "expected", "missing")], F.bool_and("structural_passed").alias("structural_passed"), F.bool_and("passed").alias("passed"))


def incomplete(groups: DataFrame) -> DataFrame:
    return groups.where("missing > 0")


def quarantine(groups: DataFrame, production: list[str]) -> DataFrame:
    """Groups with their publication state: published, quarantined, or blocking (a production symbol that fails)."""
    own = F.col("symbol").isin(production)
    return groups.select("*", F.when(F.col("passed"), "published").when(own, "blocking").otherwise("quarantined").alias("publication_state"))


def effective_production(declared: list[str], core: list[str], bars: DataFrame) -> DataFrame:
    """Declared symbols and the observed ones of the core."""
    seen = bars.where(F.col("symbol").isin(core)).select("symbol").distinct()
    return seen.unionByName(bars.sparkSession.createDataFrame([(s,) for s in declared], "symbol string")).distinct()
