"""Session calendars and grids (SURVEY B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS session_date")


def continuous(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A calendar of whole UTC days."""
    open_ = F.col("session_date").cast("timestamp")
    return days(spark, first, last).select("session_date", open_.alias("open_utc"), (open_ + F.expr("interval 24 hours")).alias("close_utc"))


def _nth(month: int, day: int, n: int) -> Column:
    """Whether the date is the n-th such weekday (1: Sunday) of the month."""
    d = F.col("session_date")
    return (F.month(d) == month) & (F.dayofweek(d) == day) & (F.ceil(F.dayofmonth(d) / 7) == n)


def _observed(month: int, day: int) -> Column:
    """A fixed holiday, kept on Friday or Monday if it falls on a weekend."""
    d = F.col("session_date")
    on = lambda x: (F.month(x) == month) & (F.dayofmonth(x) == day)
    return on(d) | (on(F.date_sub(d, 1)) & (F.dayofweek(d) == 2)) | (on(F.date_add(d, 1)) & (F.dayofweek(d) == 6))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (Gauss's rule in the form of Anonymous, 1876)."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - F.floor(b / 4) - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    ell = (32 + 2 * (b % 4) + 2 * i - h - k) % 7
    m = F.floor((a + 11 * h + 22 * ell) / 451)
    n = h + ell - 7 * m + 114
    return F.make_date(year, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))


def new_york(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Sessions of the New York exchanges by rule: weekdays without holidays, 9:30 to 16:00, or to 13:00 on short days."""
    d = F.col("session_date")
    new_year = (F.month(d) == 1) & (F.dayofmonth(d) == 1) | (F.month(d) == 1) & (F.dayofmonth(d) == 2) & (F.dayofweek(d) == 2)
    memorial = (F.month(d) == 5) & (F.dayofweek(d) == 2) & (F.dayofmonth(d) > 24)
    good_friday = d == F.date_sub(easter(F.year(d)), 2)
    holiday = new_year | _nth(1, 2, 3) | _nth(2, 2, 3) | good_friday | memorial | (_observed(6, 19) & (F.year(d) >= 2022)) | _observed(7, 4) | _nth(9, 2, 1) | _nth(11, 5, 4) | _observed(12, 25)
    after_thanks = (F.month(d) == 11) & (F.dayofweek(d) == 6) & F.dayofmonth(d).between(23, 29)
    short = after_thanks | (F.month(d) == 12) & (F.dayofmonth(d) == 24) | (F.month(d) == 7) & (F.dayofmonth(d) == 3) & F.dayofweek(d).between(2, 5)
    at = lambda clock: F.to_utc_timestamp(F.concat(d.cast("string"), F.lit(f" {clock}")), "America/New_York")
    rows = days(spark, first, last).where(F.dayofweek(d).between(2, 6) & ~holiday)
    return rows.select("session_date", at("09:30:00").alias("open_utc"), F.when(short, at("13:00:00")).otherwise(at("16:00:00")).alias("close_utc"))


def grid(calendar: DataFrame, minutes: int = 1) -> DataFrame:
    """The expected instants of each session, open to close without the close, with their position."""
    step = F.expr(f"interval {minutes} minutes")
    return calendar.select("session_date", F.posexplode(F.sequence(F.col("open_utc"), F.col("close_utc") - step, step)).alias("slot", "bar_start"))


def boundaries(minutes: DataFrame, n: int, step: int = 1) -> DataFrame:
    """Instants at which an n-slot bar is complete."""
    return minutes.where((F.col("slot") + 1) % n == 0).select("session_date", (F.col("bar_start") + F.expr(f"interval {step} minutes")).alias("available_at"))


def session_clock(calendar: DataFrame, buffer_minutes: int = 5) -> DataFrame:
    """Open, close, closeout time and the minute before it, when its signal falls."""
    if not 1 <= buffer_minutes <= 60:
        raise ValueError("buffer_minutes must lie in 1..60")
    closeout = F.col("close_utc") - F.expr(f"interval {buffer_minutes} minutes")
    return calendar.select("*", closeout.alias("closeout_utc"), (closeout - F.expr("interval 1 minute")).alias("closeout_signal_utc"))


def expected_groups(symbols: DataFrame, calendar: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(symbol, session_date) that must have bars: each symbol in each session, and declared extra groups."""
    sessions = calendar.agg(F.collect_set("session_date").alias("d"))  # one value a session day
    out = symbols.select("symbol").distinct().join(F.broadcast(sessions)).select("symbol", F.explode("d").alias("session_date"))
    return out if extra is None else out.unionByName(extra.select("symbol", "session_date")).distinct()
