"""Small cases of the bar-series operators with results worked out by hand or by a plain loop."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendars, evidence, features, gates, metrics, quality, robustness, rules, trades
from tickloom.sources import bars as sources

UTC = dt.timezone.utc


def test_new_york_sessions(spark):
    cal = calendars.new_york(spark, "2024-01-01", "2026-12-31")
    got = {r.session_date: r for r in cal.collect()}
    closed = ["2024-01-01", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-11-28", "2024-12-25", "2025-04-18", "2026-04-03", "2026-07-03"]
    assert not [d for d in closed if dt.date.fromisoformat(d) in got]
    assert sum(d.year == 2024 for d in got) == 252
    short = cal.where("unix_timestamp(close_utc) - unix_timestamp(open_utc) = 12600 AND year(session_date) = 2024")
    assert sorted(str(r.session_date) for r in short.collect()) == ["2024-07-03", "2024-11-29", "2024-12-24"]
    opens = {str(r.session_date): r.hour for r in cal.select("session_date", F.hour("open_utc").alias("hour")).collect()}
    assert opens["2024-01-02"] == 14 and opens["2024-07-02"] == 13
    grid = calendars.grid(cal.where("session_date = DATE'2024-07-02'"))
    assert grid.count() == 390 and calendars.boundaries(grid, 15).count() == 26
    clock = calendars.session_clock(cal, 10).first()
    assert (clock.close_utc - clock.closeout_utc).seconds == 600
    with pytest.raises(ValueError):
        calendars.session_clock(cal, 0)


def test_canonical_rejects(spark):
    raw = spark.createDataFrame(
        [(" aapl ", "2026-07-02T13:30:00Z", "1", "2", "0.5", "1.5", "10"), ("MSFT", "2026-07-02T13:30:00", "1", "2", "1", "1", "1"), ("MSFT", "2026-07-02T13:31:00+00:00", "x", "2", "1", "1", "1"), ("A B", "2026-07-02T13:31:00Z", "1", "1", "1", "1", "1"), (None, None, None, None, None, None, None), ("MSFT", "2026-07-02T13:31:00Z", "1", "NaN", "1", "1", "1")],
        sources.RAW,
    )
    out = sources.canonical(raw, "p", "f").collect()
    assert [r.reject for r in out] == [None, "timestamp", "open", "symbol", "symbol", "high"]
    assert out[0].symbol == "AAPL" and out[0].session_date == dt.date(2026, 7, 2)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,date,open,high,low,close,volume\nspy,2026-07-02T13:30:00Z,1,2,1,2,5\n")
    bars = sources.canonical(sources.read_csv(spark, f"{tmp_path}/a.csv"), "p", "f").withColumn("bar_size", F.lit("1min"))
    sources.write_bars(bars, f"{tmp_path}/out")
    back = sources.read_parquet(spark, f"{tmp_path}/out")
    assert back.count() == 1 and "bar_size" in back.columns
    assert sources.json_lines(bars.select("symbol", "timestamp")).first().value == '{"symbol":"SPY","timestamp":"2026-07-02T13:30:00Z"}'
    prof = sources.profile(bars.select("symbol", "timestamp"), F.lit("x")).first()
    assert (prof.rows, prof.symbols) == (1, ["SPY"])
    with pytest.raises(ValueError):
        sources.require_one_schema([bars, bars.drop("feed")])
    with pytest.raises(ValueError):
        sources.role(spark.range(1), sources.TIME_NAMES)


def make_bars(spark, closes, symbol="S"):
    rows = [(symbol, dt.date(2024, 1, 2), i, c, c + 0.5, c - 0.5, c, 100 + i, dt.datetime(2024, 1, 2, i % 24, 0), dt.datetime(2024, 1, 2, i % 24, 1)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, session_date date, slot int, open double, high double, low double, close double, volume long, bar_start timestamp, available_at timestamp")


def test_features_equal_pandas(spark):
    closes = np.round(100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 24)), 2).tolist()
    got = features.feature_frame(make_bars(spark, closes)).orderBy("slot").toPandas()
    c = pd.Series(closes)
    ema = c.ewm(span=3, adjust=False, min_periods=3).mean() / c.ewm(span=8, adjust=False, min_periods=8).mean() - 1
    ch = c.diff()
    gain, loss = ch.clip(lower=0).rolling(14, min_periods=14).mean(), (-ch.clip(upper=0)).rolling(14, min_periods=14).mean()
    want = {"return_1": c.pct_change(), "return_3": c.pct_change(3), "ema_spread": ema, "rsi": 100 - 100 / (1 + gain / loss)}
    for name, x in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), x.to_numpy(), rtol=1e-12)


def test_feature_edges(spark):
    flat = features.feature_frame(make_bars(spark, [5.0] * 16).withColumn("high", F.col("close")).withColumn("low", F.col("close")).withColumn("volume", F.lit(0))).orderBy("slot").collect()
    assert flat[15].rsi == 50.0 and flat[15].range_position == 0.5 and flat[15].vwap_distance_bps is None and flat[0].return_1 is None
    up = features.feature_frame(make_bars(spark, [float(i + 1) for i in range(16)])).orderBy("slot").collect()
    assert up[15].rsi == 100.0 and up[13].rsi is None


def test_resample_leaves_gaps(spark):
    bars = make_bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).where("slot <> 3")
    out = {r.block: r for r in features.resample(bars, 2).collect()}
    assert sorted(out) == [0, 2] and out[2].open == 5.0 and out[2].close == 6.0 and out[2].volume == 209
    assert features.resample(bars.unionByName(bars.where("slot = 0")), 2).count() == 1


def test_quality(spark):
    cal = calendars.continuous(spark, "2024-01-02", "2024-01-02")
    bars = make_bars(spark, [1.0, 2.0, 3.0])
    bad = bars.where("slot = 0").withColumn("high", F.lit(0.1)).unionByName(bars).unionByName(bars.where("slot = 1").withColumn("bar_start", F.lit("2024-01-02 00:30:00").cast("timestamp")))
    expected = calendars.expected_groups(spark.createDataFrame([("S",), ("T",)], "symbol string"), cal)
    got = {r.symbol: r for r in quality.assess(bad, calendars.grid(cal, 60), expected).collect()}
    s, t = got["S"], got["T"]
    assert (s.observed, s.duplicate_rows, s.invalid_ohlc_rows, s.outside_rows, s.missing, s.structural_passed) == (5, 1, 1, 1, 21, False)
    assert (t.observed, t.missing, t.structural_passed, t.passed) == (0, 24, True, False)


def test_rules_lint_and_contradictions(spark):
    bad = {"r1": {"all": [{"indicator": "rsi", "op": "gte", "value": 5}, {"indicator": "rsi", "op": "lte", "value": 5}]}, "r2": {"all": [{"indicator": "rsi", "op": "gt", "value": 5}, {"indicator": "rsi", "op": "lte", "value": 5}]}, "r3": {"any": [{"indicator": "nope", "op": "eq", "value": 1}]}}
    table = rules.rule_table(spark, bad)
    assert [r.strategy_id for r in rules.contradictions(table).collect()] == ["r2"]
    assert sorted(r.code for r in rules.lint(table).collect()) == ["UNKNOWN_COMPARISON", "UNKNOWN_INDICATOR"]
    frame = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, float("inf"))], "id int, rsi double")
    assert [r.id for r in rules.signals(frame, {"r1": bad["r1"]}, ("id",)).collect()] == [1]


def test_as_of_against_loop(spark):
    rng = np.random.default_rng(0)
    left = [(k, int(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b"], 60), rng.integers(0, 40, 60), strict=True))]
    right = [(k, int(t), float(v)) for k, t, v in zip(rng.choice(["a", "b"], 50), rng.integers(0, 40, 50), rng.permutation(50), strict=True)]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v double")
    for direction in ("after", "before"):
        for strict in (True, False):
            got = {r.i: r.x for r in trades.as_of(a, b, ("k",), "t", "t", "v", direction, strict, "x").collect()}
            for k, t, i in left:
                if direction == "after":
                    c = [(u, v) for j, u, v in right if j == k and (u > t or u == t and not strict)]
                    want = min(c)[1] if c else None
                else:
                    c = [(u, v) for j, u, v in right if j == k and (u < t or u == t and not strict)]
                    want = max(c)[1] if c else None
                assert got[i] == want


def test_fifo_against_loop(spark):
    rng = np.random.default_rng(6)
    log = [(str(rng.integers(5)), i, rng.choice(["buy", "sell"]).item(), int(rng.integers(0, 9))) for i in range(200)]
    want = []
    for key in set(r[0] for r in log):
        held = []
        for rank, (_, _, side, q) in enumerate([r for r in log if r[0] == key], 1):
            if side == "buy":
                held.append([rank, q])
                continue
            while q and held:
                take = min(q, held[0][1])
                if take:
                    want.append((key, held[0][0], rank, take))
                q, held[0][1] = q - take, held[0][1] - take
                if not held[0][1]:
                    held.pop(0)
    lots = trades.fifo_lots(spark.createDataFrame(log, "k string, i int, side string, quantity long"), ("k",), ["i"])
    assert sorted(tuple(r) for r in lots.select("k", "buy_rank", "sell_rank", "quantity").collect()) == sorted(want)


def test_accept_entries(spark):
    rows = [("s", "d", "A", 1, 0, 100), ("s", "d", "A", 2, 50, 150), ("s", "d", "A", 3, 130, 200), ("s", "d", "A", 4, 161, 300), ("s", "d", "B", 5, 170, 300), ("s", "d", "C", 6, 180, 300)]
    got = trades.accept_entries(spark.createDataFrame(rows, "strategy_id string, session_date string, symbol string, entry_id long, entry_s long, exit_s long"), 60, 10, 2).collect()
    assert sorted(r.entry_id for r in got if r.accepted) == [1, 4, 5]


def test_drawdown_and_returns(spark):
    d = dt.date(2024, 1, 1)
    rows = [("s", d + dt.timedelta(i // 2), i, e) for i, e in enumerate([100.0, 120.0, 90.0, 95.0, 60.0, 130.0])]
    equity = spark.createDataFrame(rows, "strategy_id string, session_date date, event_time int, equity double")
    assert metrics.max_drawdown(equity, 110.0).first().max_drawdown == 0.5
    got = [round(r.session_return, 6) for r in metrics.session_returns(equity, 100.0).orderBy("session_date").collect()]
    assert got == [0.2, round(95 / 120 - 1, 6), round(130 / 95 - 1, 6)]
    one = metrics.risk(metrics.session_returns(equity.limit(1), 100.0)).first()
    assert (one.annualized_volatility, one.sharpe) == (0.0, 0.0)


def test_split_and_windows(spark):
    for n, want in ((10, (7, 2, 1)), (13, (9, 3, 1)), (17, (12, 3, 2)), (30, (21, 6, 3))):
        days = spark.range(n).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("session_date"))
        got = {r.phase: r["count"] for r in metrics.chronological_split(days).groupBy("phase").count().collect()}
        assert (got["train"], got["validation"], got["final"]) == want
    windows = metrics.walk_forward(days, 10, 5, 7)
    assert {(r.window_id, r.role, r["count"]) for r in windows.groupBy("window_id", "role").count().collect()} == {(i, x, c) for i in range(3) for x, c in (("train", 10), ("evaluation", 5))}


def test_null_masks_keep_counts(spark):
    opp = spark.createDataFrame([(i, f"d{i % 3}", i % 4 == 0) for i in range(60)], "opportunity_id long, session_date string, entered boolean")
    for out in (metrics.permuted(opp, 5).where("shuffled"), metrics.shifted(opp, 5)):
        counts = out.groupBy("session_date", "rep").agg(F.count("*").alias("n"), F.countDistinct("opportunity_id").alias("m")).collect()
        assert {(r.n, r.m) for r in counts} == {(5, 5)} and len(counts) == 15
    assert metrics.permuted(opp, 5).count() == 300
    assert metrics.nearest_rank(opp, "opportunity_id", 0.95, "session_date").count() == 3


def test_gates(spark):
    row = spark.createDataFrame([("a", 1.0, 1.0, 100, 0.08, 1.15, 0.6, True, 0.7, True, True), ("b", 1.0, None, 99, 0.09, 1.0, 0.6, None, 0.7, True, True)], "strategy_id string, base_return double, costly_return double, trade_count int, max_drawdown double, profit_factor double, profitable_windows double, neighborhood_stable boolean, symbol_share double, start_date_stable boolean, null_test_passed boolean")
    got = {r.strategy_id: (r.decision, r.reasons) for r in gates.decide(gates.evaluate_gates(row)).collect()}
    assert got["a"] == ("PROMOTE", "")
    assert got["b"] == ("REJECT", "NONPOSITIVE_COST_1_5X_RETURN,INSUFFICIENT_TRADES,MAX_DRAWDOWN_EXCEEDED,PROFIT_FACTOR_TOO_LOW,UNSTABLE_PARAMETER_NEIGHBORHOOD")
    survivors = spark.createDataFrame([("x", 0.1, 0.1, 0.04, 0.02, 2.0, 2.0, 0.1, 0.2, 0.8), ("y", 0.1, 0.1, 0.04, 0.02, 2.0, 2.0, 0.1, 0.2, 0.8)], "strategy_id string, validation_return double, final_return double, validation_drawdown double, final_drawdown double, validation_profit_factor double, final_profit_factor double, validation_sensitivity double, final_sensitivity double, wf_share double")
    first = gates.survivor_scores(survivors).orderBy("rank").first()
    assert first.strategy_id == "x" and abs(first.score - (0.3 * 0.5 + 0.2 * 0.5 + 0.2 * 0.5 + 0.2 * 0.8 + 0.1 * 0.8)) < 1e-12


def test_grid_and_variants(spark):
    grid = gates.parameter_grid(spark, {"b": [2, 1], "a": [10, 30, 20]})
    assert [(r.a, r.b) for r in grid.orderBy("variant_rank").collect()] == [(a, b) for a in (10, 20, 30) for b in (1, 2)]
    assert gates.variants(grid.unionByName(grid.withColumn("variant_rank", F.col("variant_rank") + 10))).count() == 6
    chosen = gates.farthest_points(grid.withColumn("hypothesis_id", F.lit("h")), 2).collect()
    assert {(r.a, r.b) for r in chosen} == {(10, 1), (30, 2)}


def test_evidence(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert sorted((r.k, r.side) for r in evidence.difference(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    h = lambda df: evidence.dataset_hash(df, "k", "v").first().content_sha256
    assert h(a) == h(a.repartition(5)) != h(a.distinct())
    assert [(r.k, r.codes) for r in evidence.reconcile(a.distinct(), b, "k", ["v"]).orderBy("k").collect()] == [(2, "MISSING_AT_BROKER"), (3, "UNKNOWN_AT_LOCAL")]
    assert evidence.tampered(a.withColumn("d", F.sha2("v", 256)), "v", "d").count() == 0
    assert [tuple(r) for r in evidence.offending(a, {"v": "v = 'x'"}, "k").collect()] == [(2, "v")]
    one = spark.createDataFrame([(1, "x")], "k long, v string")
    assert [r.field for r in evidence.field_differences(one, spark.createDataFrame([(1, "z")], "k long, v string")).collect()] == ["v"]


def test_nearest_rank_of_many_rows_with_ties_and_nulls(spark):
    import math

    values = [(i % 2, (i * 7919) % 5003 // 3) for i in range(20_000)] + [(0, None), (2, None), (3, 4)]
    got = {r.k: r.threshold for r in metrics.nearest_rank(spark.createDataFrame(values, "k long, v long"), "v", 0.95, "k").collect()}
    want = {k: sorted(v for x, v in values if x == k and v is not None) for k in (0, 1, 3)}
    assert got == {k: v[max(1, math.ceil(0.95 * len(v))) - 1] for k, v in want.items()}


def test_entry_risk_refuses_in_order_and_on_nulls(spark):
    good = {"symbol_allowed": True, "minute": 60, "open_minute": 5, "close_minute": 390, "closeout_minutes": 15, "feed_age": 1, "max_feed_age": 5, "clock_age": 1, "max_clock_age": 5, "reconciliation_status": "clean", "storage_circuit_open": False,
            "account_positions": 0, "strategy_entries": 0, "strategy_enabled": True, "side": "buy", "cash": 100.0, "sizing_approved": True, "sized_quantity": 2, "quantity": 1, "required_cash": 50.0, "daily_loss": 0, "daily_loss_limit": 9, "account_loss": 0, "account_loss_limit": 9,
            "strategy_loss": 0, "strategy_loss_limit": 9, "duplicate_intent": False, "conflicting_intent": False}
    bad = [{}, {"minute": 375}, {"minute": 390}, {"feed_age": -1}, {"reconciliation_status": None, "cash": -1.0}, {"required_cash": 101.0}, {"quantity": 3, "duplicate_intent": True}, {"conflicting_intent": True}]
    got = [r.reason for r in robustness.entry_risk(spark.createDataFrame([good | b | {"i": i} for i, b in enumerate(bad)])).orderBy("i").collect()]
    assert got == ["ENTRY_RISK_APPROVED", "CLOSEOUT_BUFFER_ACTIVE", "OUTSIDE_REGULAR_HOURS", "FEED_STALE", "RECONCILIATION_NOT_CLEAN", "MARGIN_OR_LEVERAGE_REQUIRED", "QUANTITY_EXCEEDS_CONSERVATIVE_SIZE", "CONFLICTING_INTENT"]


def test_eligibility_names_every_gate_that_fails(spark):
    columns = "strategy_id string, completed_days int, closed_trades int, unresolved_reconciliations int, unresolved_overnight_incidents int, lifecycle_state string, data_completeness double, execution_quality double, capacity_available boolean"
    rows = spark.createDataFrame([("a", 30, 50, 0, 0, "paper_observing", 0.99, 0.95, True), ("b", 29, 49, 1, 1, "paper_active", 0.98, None, False)], columns)
    got = {r.strategy_id: (r.decision, r.reasons) for r in gates.decide(gates.evaluate_gates(rows, robustness.ELIGIBILITY)).collect()}
    assert got == {"a": ("PROMOTE", ""), "b": ("REJECT", ",".join(c for c, _ in robustness.ELIGIBILITY))}


def test_reconciliation_codes(spark):
    orders = "account long, order_id long, symbol string, side string, quantity long, filled long, status string"
    local = spark.createDataFrame([(1, 1, "A", "buy", 5, 0, "submitted"), (1, 2, "A", "buy", 5, 5, "filled"), (2, 3, "B", "buy", 4, 0, "submitted"), (3, 4, "C", "buy", 4, 0, "submitted"), (4, 5, "D", "buy", 1, 1, "filled"), (5, 6, "E", "sell", 2, 0, "accepted")], orders)
    broker = spark.createDataFrame([(1, 1, "A", "buy", 5, 5, "filled"), (1, 2, "A", "buy", 5, 5, "filled"), (3, 4, "C", "buy", 9, 0, "submitted"), (3, 9, "C", "buy", 1, 0, "submitted"), (4, 5, "D", "buy", 1, 0, "cancelled")], orders)
    held = spark.createDataFrame([(1, "A", 5), (5, "E", 3)], "account long, symbol string, held long")
    broker_held = spark.createDataFrame([(1, "A", 5), (2, "B", 4), (5, "E", 4), (4, "X", 1)], "account long, symbol string, held long")
    found = evidence.order_discrepancies(local, broker, held, broker_held)
    found = found.unionByName(evidence.position_discrepancies(held, broker_held, found.where("code = 'PENDING_ENTRY_FILLED_AT_BROKER'")))
    got = {r.account: (r.status, r.codes) for r in evidence.reconciliation_status(local.unionByName(spark.createDataFrame([(9, 9, "Z", "buy", 1, 1, "filled")], orders)), found).collect()}
    assert got == {1: ("recoverable", "LOCAL_ORDER_STATUS_STALE"), 2: ("recoverable", "PENDING_ENTRY_FILLED_AT_BROKER"), 3: ("blocked", "ORDER_IDENTITY_MISMATCH,UNKNOWN_BROKER_ORDER"),
                   4: ("blocked", "BROKER_POSITION_MISSING_LOCALLY,ORDER_STATUS_MISMATCH"), 5: ("blocked", "LOCAL_OPEN_ORDER_MISSING_AT_BROKER,POSITION_QUANTITY_MISMATCH"), 9: ("clean", "")}


def test_shifted_profits_in_blocks(spark):
    from tickloom.operators import metrics

    rows = [(f"d{g}", i * 7919 % 1009, (i * i + g) % 5 == 0, i * 31 % 97 - 40) for g, many in enumerate((1, 2, 14, 15, 50)) for i in range(many)]
    rows += [("none", i, False, 5) for i in range(9)]
    opp = spark.createDataFrame(rows, "session_date string, opportunity_id long, entered boolean, profit long")
    want = sorted(map(tuple, metrics.shifted(opp, 12).groupBy("rep").agg({"profit": "sum"}).collect()))
    for block in (1, 7, 64):
        assert sorted(map(tuple, metrics.shifted_profits(opp, 12, block=block).collect())) == want
