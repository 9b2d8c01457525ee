"""As-of joins, fills, trades and lots (SURVEY F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import nulls, sweeps

# One-way price impact of each cost scenario, in basis points.
SCENARIOS = {"base": 3.0, "optimistic": 1.0, "stress": 7.0}


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, value: str, direction: str, strict: bool, alias: str) -> DataFrame:
    """left with `alias`: the struct `value` of the nearest right row of the same keys, after or before left_time; null if there is none.

    Both sides are put in one order and the nearest right row is carried over the window, so nothing is multiplied. With equal
    times a right row counts unless strict. Among right rows of one time the smallest struct (after) or the largest (before) counts.
    """
    after = direction == "after"
    first_right = after == strict  # whether right rows of the same time come before left ones in time order
    rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(int(first_right)).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_value"))
    marks = right.select(*keys, F.col(right_time).alias("_t"), F.lit(int(not first_right)).alias("_side"), F.lit(None).alias("_left"), F.col(value).alias("_value"))
    both = rows.unionByName(marks)
    order = [F.col("_t"), F.col("_side"), F.col("_value")]
    w = Window.partitionBy(*keys).orderBy(*order)
    found = F.first("_value", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if after else F.last("_value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.select("_left", found.alias(alias)).where("_left IS NOT NULL").select("_left.*", alias)


def market_price(price: Column, side: Column, impact_bps: Column) -> Column:
    """The price moved against the side by the impact."""
    return price * (1 + F.when(side == "buy", impact_bps).otherwise(-impact_bps) / 10_000.0)


def with_scenarios(df: DataFrame) -> DataFrame:
    """df once for each cost scenario."""
    table = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(b).alias("impact_bps")) for s, b in sorted(SCENARIOS.items())])
    return df.select("*", F.explode(table).alias("_s")).select(*df.columns, "_s.scenario", "_s.impact_bps")


def limit_fills(orders: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("symbol", "session_date")) -> DataFrame:
    """Limit orders with the first later bar that touches the limit, and the limit as price; null if none does before the session's end."""
    first = sweeps.limit_touches(orders, bars, keys)
    return orders.join(first, [*keys, "order_id"], "left").withColumn("fill_price", F.when(F.col("fill_time").isNotNull(), F.col("limit_price")))


def exits(entries: DataFrame, bars: DataFrame, stop_bps: float, take_bps: float, hold_minutes: int, keys: tuple[str, ...] = ("symbol", "session_date")) -> DataFrame:
    """Each entry's exit: the first bar after it whose close passes the stop, then the target, or that reaches the holding time; else the session's last bar."""
    return sweeps.exits(entries, bars, stop_bps, take_bps, hold_minutes, keys)


def quantity(notional: Column, price: Column) -> Column:
    return F.floor(notional / price)


def equal_risk_quantity(risk: Column, price: Column, stop_price: Column) -> Column:
    """Whole shares whose loss at the stop stays within the risk; none where the stop is not below the price."""
    return F.when(price > stop_price, F.floor(risk / (price - stop_price))).otherwise(0)


def conservative_size(cash: Column, equity: Column, price: Column, stop_distance: Column, max_fraction: float = 0.25, risk_fraction: float = 0.005) -> Column:
    """Struct of whole shares and the cap that binds: cash, position or risk; ties go to the first name in order."""
    caps = {"cash": F.floor(cash / price), "position": F.floor(equity * max_fraction / price), "risk": F.floor(equity * risk_fraction / stop_distance)}
    return F.least(*[F.struct(v.alias("quantity"), F.lit(k).alias("cap")) for k, v in sorted(caps.items())])


def with_balances(df: DataFrame, balances: tuple[int, ...] = (5_000, 10_000, 25_000)) -> DataFrame:
    return df.select("*", F.explode(F.array(*map(F.lit, balances))).alias("balance"))


def accept_entries(entries: DataFrame, cooldown_seconds: int, max_entries: int, max_open: int, keys: tuple[str, ...] = ("strategy_id", "session_date")) -> DataFrame:
    """entries with `accepted`, decided in time order within a session: no overlap in a symbol, a cooldown after an exit, and limits
    on entries and on open positions.

    Columns: keys, symbol, entry_id, entry_s and exit_s (seconds)."""
    return nulls.accepted(entries, cooldown_seconds, max_entries, max_open, keys)


def fifo_lots(log: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """Matched lots of a log of buys and sells: keys, buy_rank, sell_rank, quantity.

    Buys and sells are intervals on the axis of cumulative quantity; a lot is an overlap, found by merging the starts of both in one window. What is sold beyond the holding is lost:
    the running maximum of sold less bought is taken off the sells' positions. Columns: keys, order, side, quantity.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    q = F.col("quantity")
    rows = log.select("*", F.row_number().over(w).alias("_rank"), F.sum(F.when(buy, q).otherwise(0)).over(so_far).alias("_bought"), F.sum(F.when(sell, q).otherwise(0)).over(so_far).alias("_sold"))
    rows = rows.withColumn("_lost", F.greatest(F.lit(0), F.max(F.col("_sold") - F.col("_bought")).over(so_far)))
    rows = rows.withColumn("_lost_before", F.coalesce(F.lag("_lost").over(w), F.lit(0)))
    buys = rows.where(buy & (q > 0)).select(*keys, F.lit("buy").alias("kind"), (F.col("_bought") - q).alias("at"), F.col("_bought").alias("end"), F.col("_rank").alias("rank"))
    sells = rows.where(sell & (q > 0)).select(*keys, F.lit("sell").alias("kind"), (F.col("_sold") - q - F.col("_lost_before")).alias("at"), (F.col("_sold") - F.col("_lost")).alias("end"), F.col("_rank").alias("rank"))
    # a lot begins where the later of its two intervals does: each start carries the latest buy and the latest sell
    here = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("at", "end", "rank"))).over(here)
    starts = buys.unionByName(sells).where("end > at").select(*keys, "kind", latest("buy").alias("b"), latest("sell").alias("s"))
    lots = starts.where("kind = 'buy' AND b.at >= s.at OR kind = 'sell' AND s.at > b.at").where("least(b.end, s.end) > greatest(b.at, s.at)")
    return lots.select(*keys, F.col("b.rank").alias("buy_rank"), F.col("s.rank").alias("sell_rank"), (F.least("b.end", "s.end") - F.greatest("b.at", "s.at")).alias("quantity"))


def equity_marks(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """At each bar of a symbol and session: the quantity held by open trades, its value at the close, and realised P&L so far.

    Entries and exits are steps on the bars' time axis: one union and a running sum, not a join of trades with bars.
    """
    steps = trades.select("symbol", "session_date", F.col("entry_time").alias("t"), F.col("quantity").alias("dq"), F.lit(0.0).alias("pnl"), F.lit(None).cast("double").alias("close"))
    steps = steps.unionByName(trades.select("symbol", "session_date", F.col("exit_time").alias("t"), (-F.col("quantity")).alias("dq"), F.col("net_pnl").alias("pnl"), F.lit(None).cast("double").alias("close")))
    marks = bars.select("symbol", "session_date", F.col("bar_start").alias("t"), F.lit(0).cast("long").alias("dq"), F.lit(0.0).alias("pnl"), "close")
    w = Window.partitionBy("symbol", "session_date").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    rows = steps.unionByName(marks).select("symbol", "session_date", "t", "close", F.sum("dq").over(w).alias("held"), F.sum("pnl").over(w).alias("realised"))
    return rows.where("close IS NOT NULL").select("symbol", "session_date", F.col("t").alias("bar_start"), "held", (F.col("held") * F.col("close")).alias("market_value"), "realised")


def opportunities(bars: DataFrame, hold: int, budget: float, cost: float) -> DataFrame:
    """What an entry after each bar would have earned: bought at the next bar's open with the budget, sold at the close `hold` bars after this one or
    the session's last, less the cost share of both sides. Bars without a next one in their session give none."""
    w = Window.partitionBy("symbol", "session_date").orderBy("slot")
    last = F.last("close").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    end = F.last("slot").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = bars.select("symbol", "session_date", "slot", F.lead("open").over(w).alias("entry_price"), F.coalesce(F.lead("close", hold).over(w), last).alias("exit_price"), F.lead("slot").over(w).alias("entry_slot"), F.coalesce(F.lead("slot", hold).over(w), end).alias("exit_slot"))
    rows = rows.where("entry_price IS NOT NULL").withColumn("quantity", F.floor(F.lit(budget) / F.col("entry_price")))
    return rows.withColumn("net_pnl", F.col("quantity") * (F.col("exit_price") * (1 - cost) - F.col("entry_price") * (1 + cost)))
