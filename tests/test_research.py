"""Phases, documents, large grids, snapshots and replay states."""

import datetime as dt
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import documents, evidence, gates, quality, robustness, snapshots
from tickloom.plans import document_queries

DAY = dt.date(2024, 1, 1)


def test_phases_and_preference(spark):
    rows = [("a", s, DAY + dt.timedelta(d), p, 2) for d, p, s in [(0, 10, "x"), (1, -4, "y"), (1, 6, "x"), (2, 8, "x"), (3, -3, "y"), (4, 5, "x")]] + [("b", "x", DAY, -1, 0), ("b", "x", DAY + dt.timedelta(2), -5, 1)]
    trades = spark.createDataFrame(rows, "strategy_id string, symbol string, session_date date, net_pnl long, cost long")
    labels = spark.createDataFrame([(DAY + dt.timedelta(d), "train" if d < 1 else "validation" if d < 3 else "final") for d in range(5)], "session_date date, phase string")
    got = {(r.strategy_id, r.phase): r for r in robustness.phase_results(trades, labels, 100.0).collect()}
    v = got["a", "validation"]
    assert (v.base_return, v.costly_return, v.trade_count, v.profit_factor, v.symbol_share) == (0.1, 0.07, 3, 14 / 4, 1.0)
    assert v.max_drawdown == 0.0 and got["a", "final"].max_drawdown == pytest.approx(0.03)
    assert (got["b", "validation"].profit_factor, got["b", "validation"].symbol_share, got["b", "validation"].max_drawdown) == (0.0, None, pytest.approx(0.05))
    results = robustness.phase_results(trades, labels, 100.0)
    survivors = robustness.preselected(results, min_trades=3)
    assert [r.strategy_id for r in survivors.collect()] == ["a"]
    assert {r.strategy_id: r.phase for r in robustness.preferred_phase(results, survivors).collect()} == {"a": "final", "b": "validation"}
    windows = spark.createDataFrame([(0, DAY), (0, DAY + dt.timedelta(1)), (1, DAY + dt.timedelta(3)), (2, DAY + dt.timedelta(9))], "window_id int, session_date date")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "strategy_id string")
    share = {r.strategy_id: r.profitable_windows for r in robustness.profitable_windows(trades, windows, names).collect()}
    assert share == {"a": pytest.approx(1 / 3), "b": 0.0, "c": 0.0}


GOOD = {"strategy_id": "s", "dsl_version": "1.0.0", "symbols": ["SPY"], "signal_bar_size": "15min", "entry": {"all": [{"indicator": "rsi", "op": "gt", "value": 1}]}, "exit": {"indicator": "rsi", "op": "lt", "value": 0.5}, "risk": {"stop_loss_bps": 1, "take_profit_bps": 10_000, "max_holding_minutes": 1_440, "cooldown_minutes": 1, "max_entries_per_session": 3, "sizing_preset": "equal_cash_conservative"}, "order_type": "limit"}


def issues(spark, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    nodes = documents.walked(rows, "id", "doc")
    found = documents.rule_issues(nodes, "id", ("SPY",)).unionByName(documents.forbidden_fields(nodes, "id")).collect()
    return {i: sorted((r.code, r.path) for r in found if r.id == i) for i in range(len(docs))}


def test_documents(spark):
    leaf = {"indicator": "rsi", "op": "gt", "value": 1}
    deep = GOOD | {"entry": {"all": [{"any": [{"all": [leaf]}]}]}}
    wide = GOOD | {"entry": {"all": [leaf] * 12}}
    bad = GOOD | {"risk": GOOD["risk"] | {"stop_loss_bps": 1.5, "cooldown_minutes": True, "max_entries_per_session": 4, "max_holding_minutes": -1}, "symbols": ["SPY", "X", 3], "order_type": None}
    odd = GOOD | {"exit": GOOD["exit"] | {"target-position": 1, "LimitPriceOffset": 2}, "nested": [{"SourceURL": {"a": 1}}], "pricing": {"limitOffsetBps": 1}}
    found = issues(spark, [json.dumps(GOOD), json.dumps(deep), json.dumps(wide), json.dumps(bad), json.dumps(odd), "{", None, "[]", json.dumps({k: v for k, v in GOOD.items() if k not in ("exit", "risk")}), "[" * 30 + "]" * 30, json.dumps({"a": [0] * 2000})])
    assert found[0] == []
    assert found[1] == [("DSL_CONDITION_DEPTH_EXCEEDED", "entry.all[0].any[0].all[0]")]
    assert found[2] == [("DSL_CONDITION_LEAF_LIMIT_EXCEEDED", "entry")]
    assert found[3] == [("DSL_INVALID_RISK_FIELD", "risk.cooldown_minutes"), ("DSL_INVALID_RISK_FIELD", "risk.stop_loss_bps"), ("DSL_INVALID_SYMBOL_TYPE", "symbols[2]"), ("DSL_MAX_ENTRIES_EXCEEDED", "risk.max_entries_per_session"), ("DSL_NON_POSITIVE_RISK_CONTROL", "risk.max_holding_minutes"), ("DSL_UNSUPPORTED_ORDER_TYPE", "order_type"), ("DSL_UNSUPPORTED_SYMBOL", "symbols[1]")]
    assert ("DSL_FORBIDDEN_FIELD", "nested[0].SourceURL") in found[4] and ("DSL_EXIT_CAN_INCREASE_EXPOSURE", "exit.target-position") in found[4]
    assert {("DSL_UNSUPPORTED_LIMIT_OFFSET", "exit.LimitPriceOffset"), ("DSL_UNSUPPORTED_LIMIT_OFFSET", "pricing.limitOffsetBps")} <= set(found[4])
    assert found[5] == found[6] == [("DSL_INVALID_JSON", "")]
    assert [c for c, _ in found[8]] == ["DSL_MISSING_FIELD"] * 2 and found[7] == []
    assert "DSL_RAW_PAYLOAD_DEPTH_EXCEEDED" in {c for c, _ in found[9]} and "DSL_RAW_PAYLOAD_NODE_BUDGET_EXCEEDED" in {c for c, _ in found[10]}


def test_ranks_are_a_permutation():
    for total in (1, 2, 10, 97, 1000):
        for seed in (0, 1, 12345):
            everything = gates.pool_ranks(total, max(1, total - 1), seed)
            assert len(set(everything)) == len(everything) and all(0 <= r < total for r in everything)
    huge = gates.pool_ranks(10**15 + 37, 2000, 5)
    assert len(set(huge)) == 2000 and max(huge) > 9 * 10**14 and min(huge) < 10**14


def test_variants_of_large_grids(spark):
    rows = document_queries.hypotheses(spark, "/root/testdata/sf0.001").limit(3).collect()
    got = gates.spread_variants(spark.createDataFrame(rows), "s_suppkey").collect()
    for h in rows:
        own = [(r.ordinal, r.reason, json.loads(r.parameters)) for r in got if r.s_suppkey == h.s_suppkey]
        assert [o for o, _, _ in sorted(own, key=lambda x: x[0])] == list(range(12))
        cells = [c for _, _, c in sorted(own, key=lambda x: x[0])]
        names = sorted(h.ranges)
        place = lambda c: np.array([h.ranges[n].index(c[n]) / 9 for n in names])  # noqa: B023, E731
        assert [r for _, r, _ in sorted(own, key=lambda x: x[0])] == ["baseline", "lower_boundary", "upper_boundary"] + ["space_filling"] * 9
        assert cells[0] == h.baseline and (place(cells[1]) == 0).all() and (place(cells[2]) == 1).all()
        pool = []
        for rank in gates.pool_ranks(10**9, 256, h.seed):
            digits = []
            for _ in names:
                rank, i = divmod(rank, 10)
                digits.append(i)
            pool.append(np.array(digits[::-1]) / 9)
        taken = [place(c) for c in cells[:3]]
        for c in cells[3:]:  # each is a farthest one of the pool
            best = max(min(np.abs(p - x).sum() for x in taken) for p in pool)
            assert min(np.abs(place(c) - x).sum() for x in taken) == pytest.approx(best)
            taken.append(place(c))


def test_variants_of_small_grids_and_odd_hypotheses(spark):
    schema = "hypothesis_id string, ranges map<string,array<double>>, baseline map<string,double>, budget int, seed long"
    rows = [("small", {"a": [2.0, 1.0], "b": [5.0]}, {"a": 2.0, "b": 5.0}, 9, 1), ("none", {}, {}, 5, 1), ("lacks", {"a": [1.0, 2.0]}, {}, 5, 1), ("null", None, None, None, None), ("two", {"a": [float(i) for i in range(50)]}, {"a": 7.0}, 2, 3)]
    got = gates.spread_variants(spark.createDataFrame(rows, schema)).orderBy("hypothesis_id", "ordinal").collect()
    assert [(r.hypothesis_id, r.reason, r.parameters) for r in got] == [("small", "baseline", '{"a": 2.0, "b": 5.0}'), ("small", "lower_boundary", '{"a": 1.0, "b": 5.0}'), ("two", "baseline", '{"a": 7.0}'), ("two", "lower_boundary", '{"a": 0.0}')]


def test_snapshots(spark, tmp_path):
    rows = [("A", DAY + dt.timedelta(d), i, float(i + 1), dt.datetime(2024, 1, 1 + d, i)) for d in range(3) for i in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, session_date date, slot int, close double, bar_start timestamp").select("symbol", "session_date", "slot", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(3).cast("long").alias("volume"), "bar_start")
    grid = bars.select("session_date", "bar_start").distinct()
    assess = lambda df: quality.assess(df, grid, bars.select("symbol", "session_date").distinct())
    path = str(tmp_path / "snapshot")
    snapshots.publish(bars, path, assess(bars))
    look = lambda: sorted(tuple(r) for r in snapshots.check(spark, path, bars.schema, assess).select("part", "key", "field").collect())
    assert look() == []
    copy = str(tmp_path / "more")
    bars.where("session_date = '2024-01-02' AND slot = 2").withColumn("low", F.lit(9.0)).repartition(1).write.partitionBy("session_date").parquet(copy)
    for f in (tmp_path / "more" / "session_date=2024-01-02").glob("part*"):
        shutil.copy(f, tmp_path / "snapshot" / "data" / "session_date=2024-01-02" / f"extra-{f.name}")
    found = look()
    assert {("manifest", "A|2024-01-02", f) for f in ("rows", "volume", "content")} < set(found)
    assert {("quality", "A|2024-01-02", f) for f in ("observed", "duplicate_rows", "invalid_ohlc_rows", "structural_passed", "passed")} < set(found)
    assert [(p, f) for p, k, f in found if p == "files" and "extra-" in k] == [("files", "present")] and not [k for _, k, _ in found if "2024-01-02" not in k]


def test_resumed_replay(spark, tmp_path):
    log = spark.createDataFrame([(i % 4, f"2024-01-0{1 + i // 5}", i, i, "ab"[i % 2]) for i in range(20)], "user long, day string, t long, n long, kind string")
    how = {"entity": "user", "time": "t", "tie": "n", "payload": "kind"}
    clean = snapshots.replay_state(log, **how)
    good, forged, none = (str(tmp_path / x) for x in ("good", "forged", "none"))
    first = snapshots.replay_state(log.where("day <= '2024-01-02'"), **how)
    snapshots.save_state(first, good, "2024-01-02")
    snapshots.save_state(first.withColumn("events", F.col("events") + (F.col("entity") == 1).cast("long")), forged, "2024-01-02")
    snapshots.save_state(first.limit(0), none, "2024-01-02")
    faults = lambda path: sorted((r.entity, r.field) for r in snapshots.state_faults(snapshots.resumed(spark, path, log, "day", **how), clean).collect())
    assert faults(good) == [] and faults(none) == [] and faults(forged) == [("1", "events")]
    assert evidence.difference(snapshots.resumed(spark, good, log, "day", **how), clean).count() == 0


def test_contracts(spark):
    from tickloom.operators import contracts

    found = lambda rows, contract, key="k": sorted((r[key], r.check) for r in contracts.faults(rows, contract, key).collect())
    orders = spark.createDataFrame([(1, 5, 5, 9.0, 1, 2), (2, 5, 6, None, 3, 2), (3, 5, 0, None, 1, 1), (4, None, 1, 1.0, 1, 1)], "k int, quantity int, filled int, average_price double, submitted_at int, updated_at int")
    assert found(orders, "broker_order") == [(2, "filled_within_quantity"), (2, "price_when_filled"), (2, "updated_after_submitted"), (4, "filled_within_quantity")]
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, float("inf"), 1.0), (3, None, -1.0)], "k int, equity double, gross_exposure double")
    assert found(points, "equity_point") == [(2, "finite_equity"), (3, "exposure_not_negative"), (3, "finite_equity")]
    scores = [("a", m, r, float(r), 1, 0) for m in ("x", "y") for r in range(4)] + [("a", "OBSERVED", 0, 2.0, 1, -1), ("b", "x", 0, 1.0, 1, 0), ("b", "OBSERVED", 0, 9.0, 1, 0)]
    own = contracts.null_evidence(spark.createDataFrame(scores, "strategy_id string, method string, rep int, profit double, accepted int, rejected int"))
    assert {(r.strategy_id, r.methods, r.threshold, r.passed) for r in own.collect()} == {("a", 2, 3.0, False), ("b", 1, 1.0, True)}
    assert found(own, "null_evidence", "strategy_id") == [("a", "counts_not_negative"), ("b", "two_methods")]
    assert found(own.withColumn("passed", ~F.col("passed")).where("strategy_id = 'a'"), "null_evidence", "strategy_id") == [("a", "counts_not_negative"), ("a", "verdict_agrees")]
    days = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "strategy_id string, session_date int")
    trades = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), ("a", "u", 3), ("z", "t", 1)], "strategy_id string, trade_id string, session_date int")
    assert {(r.strategy_id, r.check, r.n) for r in contracts.forward_faults(days, trades).collect()} == {("a", "DUPLICATE_DAY", 1), ("a", "DUPLICATE_TRADE", 1), ("a", "OUTSIDE_COMPLETED_DAYS", 1), ("z", "OTHER_STRATEGY", 1)}


def test_ranks_in_parts_equal_one_order(spark):
    rows = [(i, None if i % 50 == 0 else float(i * 7919 % 97)) for i in range(2000)]
    got = {r.k: r["rank"] for r in gates.ranked(spark.createDataFrame(rows, "k int, score double"), "score", "k", 20).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i for i, (k, _) in enumerate(order, 1)}
    assert gates.ranked(spark.createDataFrame([], "k int, score double"), "score", "k").count() == 0


def test_documents_are_walked_by_many_tasks_and_no_oftener_than_needed(spark):
    from tickloom.plans import document_queries

    nodes = document_queries.nodes(spark, "/root/testdata/sf0.001")
    assert nodes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = documents.rule_issues(nodes, "p_partkey", document_queries.SYMBOLS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_names_are_made_canonical_once(spark):
    nodes = spark.createDataFrame([(1, "a", "targetPosition", 1, "string", "x", 0)], "id int, path string, name string, depth int, kind string, value string, size int")
    plan = documents.forbidden_fields(nodes.repartition(1), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 5


def test_hypotheses_are_dealt_over_the_tasks(spark):
    from tickloom.plans import document_queries

    assert document_queries.hypotheses(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
