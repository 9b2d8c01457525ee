"""Registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "e14_feature_frame"
#: Queries whose result has a session_date.
DATED = frozenset(
    "e0_tick_bars a12_bars_of_sessions b1_grid_coverage b3_expected_groups c7_cadence c5_outside_dates d1_quality d6_non_monotonic d10_incomplete e1_resample_2h e1_resample_4h e14_feature_frame"
    " e11_minutes_from_open e13_off_boundary g4_rule_signals g1_comparison_with_semi_join f1_next_bar f2_exit_at_target f5_limit_fills f6_exits f11_cost_scenarios f12_accepted_entries f14_equity_marks h1_session_returns"
    " k1_chronological_split k4_walk_forward r1_daily_summary".split()
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows.

    A registered result shows its session_date as text, in Spark and in SQL alike.
    """

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumn("session_date", F.col("session_date").cast("string")) if "session_date" in out.columns else out

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = f"SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date) FROM ({sql})" if f.__name__ in DATED else sql
        return f

    return register


def sql_of(name: str) -> str:
    """The SQL of a query that is registered before, to build another's on."""
    return _SQL[name]


def _load() -> None:
    from tickloom.plans import bar_queries, document_queries, evidence_queries, extra_queries, gate_queries, null_queries, report_queries, research_queries, rule_queries, snapshot_queries, stream_queries, trade_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
