"""Queries of the null tests over the ticks: an opportunity is a tick, entered where the price rose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import nulls
from tickloom.plans import tables as t
from tickloom.plans.registry import query

REPS, HOLD, COOLDOWN, MOST, OPEN = 200, 3, 600, 25, 3

#: What an entry at the next tick would earn, sold HOLD ticks after this one or at the session's last.
_OPPORTUNITIES = f"""SELECT 'momentum' AS strategy_id, symbol, session_date, event_id AS opportunity_id, signal_s, lead(signal_s) OVER w AS entry_s, coalesce(lead(signal_s, {HOLD}) OVER w, last(signal_s) OVER z) AS exit_s,
        coalesce(price > lag(price) OVER w, false) AS entered, CAST(round((coalesce(lead(price, {HOLD}) OVER w, last(price) OVER z) - lead(price) OVER w) * 100) AS BIGINT) AS profit
    FROM (SELECT symbol, session_date, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS signal_s, price FROM ({t.TICKS}))
    WINDOW w AS (PARTITION BY symbol, session_date ORDER BY signal_s, event_id), z AS (PARTITION BY symbol, session_date ORDER BY signal_s, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    QUALIFY lead(signal_s) OVER w IS NOT NULL"""


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol", "session_date").orderBy("signal_s", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one that begins at the current row is read anew for each row
    ticks = t.ticks(spark, sf_dir).select("symbol", "session_date", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("signal_s"), "price")
    later = lambda c: F.coalesce(F.lead(c, HOLD).over(w), F.last(c).over(whole))
    rows = ticks.select(
        F.lit("momentum").alias("strategy_id"), "symbol", "session_date", F.col("event_id").alias("opportunity_id"), "signal_s", F.lead("signal_s").over(w).alias("entry_s"), later("signal_s").alias("exit_s"),
        F.coalesce(F.col("price") > F.lag("price").over(w), F.lit(False)).alias("entered"), F.round((later("price") - F.lead("price").over(w)) * 100).cast("long").alias("profit"),
    )
    return rows.where("entry_s IS NOT NULL")


def masks_sql(opportunities_sql: str, reps: int, seed: int = 0) -> str:
    """Every entered opportunity of every repetition: the rows of opportunities_sql with method and rep."""
    return f"""SELECT * EXCLUDE (pos, n, marks) FROM (
        SELECT *, '{nulls.PERMUTED}' AS method, CAST(r AS INTEGER) AS rep, row_number() OVER (PARTITION BY strategy_id, symbol, session_date, r ORDER BY draw, opportunity_id) <= marks AS chosen
            FROM (SELECT *, {nulls.draw_sql('opportunity_id', 'r', seed)} AS draw FROM o, range({reps}) t(r) WHERE marks > 0)
        UNION ALL BY NAME
        SELECT x.* , '{nulls.SHIFTED}' AS method, CAST(r AS INTEGER) AS rep, true AS chosen FROM
            (SELECT strategy_id, symbol, session_date, r, CASE WHEN n > 1 THEN (pos + 1 + CAST('0x' || substr(md5('shift|{seed}|' || r || '|' || strategy_id || '|' || symbol || '|' || session_date), 1, 15) AS BIGINT) % (n - 1)) % n ELSE pos END AS pos
             FROM o, range({reps}) t(r) WHERE entered) m JOIN o x USING (strategy_id, symbol, session_date, pos)
        UNION ALL BY NAME
        SELECT *, '{nulls.OBSERVED}' AS method, 0 AS rep, entered AS chosen FROM o) WHERE chosen""".replace("FROM o", "FROM placed").replace("JOIN o x", "JOIN placed x")


def scores_sql(opportunities_sql: str, reps: int, cooldown: int, most: int, most_open: int, seed: int = 0) -> str:
    """null_scores by recursion over the entries of each session and repetition."""
    return f"""WITH RECURSIVE placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy_id, symbol, session_date ORDER BY signal_s, opportunity_id) - 1 AS pos,
            count(*) OVER (PARTITION BY strategy_id, symbol, session_date) AS n, count(*) FILTER (WHERE entered) OVER (PARTITION BY strategy_id, symbol, session_date) AS marks FROM ({opportunities_sql})),
        chosen AS MATERIALIZED ({masks_sql('placed', reps, seed)}),
        e AS MATERIALIZED (SELECT strategy_id, session_date, method, rep, symbol, entry_s, exit_s, profit, row_number() OVER (PARTITION BY strategy_id, session_date, method, rep ORDER BY entry_s, symbol, signal_s, opportunity_id) AS i FROM chosen),
        f AS (SELECT strategy_id, session_date, method, rep, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(y VARCHAR, x BIGINT)[]) AS taken, CAST(0 AS BIGINT) AS profit, CAST(0 AS BIGINT) AS rejected FROM (SELECT DISTINCT strategy_id, session_date, method, rep FROM e)
            UNION ALL
            SELECT strategy_id, session_date, method, rep, i, CASE WHEN ok THEN list_append(taken, {{'y': symbol, 'x': exit_s}}) ELSE taken END, profit + CASE WHEN ok THEN gain ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
            FROM (SELECT f.strategy_id, f.session_date, f.method, f.rep, e.i, f.taken, f.profit, f.rejected, e.symbol, e.exit_s, e.profit AS gain,
                    len(f.taken) < {most} AND len(list_filter(f.taken, lambda k: k.x > e.entry_s)) < {most_open} AND len(list_filter(f.taken, lambda k: k.y = e.symbol AND e.entry_s < k.x + {cooldown})) = 0 AS ok
                  FROM f JOIN e ON e.strategy_id = f.strategy_id AND e.session_date = f.session_date AND e.method = f.method AND e.rep = f.rep AND e.i = f.i + 1))
        SELECT strategy_id, method, rep, CAST(sum(profit) AS BIGINT) AS profit, CAST(sum(len(taken)) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected
        FROM (SELECT strategy_id, session_date, method, rep, arg_max(profit, i) AS profit, arg_max(taken, i) AS taken, arg_max(rejected, i) AS rejected FROM f GROUP BY ALL) GROUP BY ALL"""


@query(f"""WITH o AS ({_OPPORTUNITIES}), g AS (SELECT strategy_id, symbol, CAST(session_date AS VARCHAR) AS session, count(*) AS slots, count(*) FILTER (WHERE entered) AS marks, count(DISTINCT signal_s) AS times, count(*) FILTER (WHERE NOT (signal_s <= entry_s AND entry_s <= exit_s)) AS odd FROM o GROUP BY ALL)
    SELECT strategy_id, symbol, session, 'UNSHIFTABLE_GROUP' AS code, slots AS n FROM g WHERE marks >= slots UNION ALL SELECT strategy_id, symbol, session, 'DUPLICATE_SIGNAL_SLOT', slots - times FROM g WHERE times < slots
    UNION ALL SELECT strategy_id, symbol, session, 'NOT_CHRONOLOGICAL', odd FROM g WHERE odd > 0 UNION ALL SELECT strategy_id, '', '', 'NOTHING_ENTERED', CAST(sum(slots) AS BIGINT) FROM g GROUP BY 1 HAVING sum(marks) = 0""")
def k11_null_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the ticks from being tested: the days of few ticks at smaller sizes, and seconds with two ticks."""
    return nulls.faults(opportunities(spark, sf_dir))


@query(scores_sql(_OPPORTUNITIES, REPS, COOLDOWN, MOST, OPEN))
def k12_null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.null_scores(opportunities(spark, sf_dir), REPS, COOLDOWN, MOST, OPEN)
