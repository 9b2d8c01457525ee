"""Streams with state against batch."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features, rules
from tickloom.plans import stream_queries
from tickloom.plans.bar_queries import RULES
from tickloom.streaming import sessions
from tickloom.streaming.sessions import SessionFeatures, holds


def test_incremental_features_equal_the_frame(spark):
    rng = np.random.default_rng(1)
    bars, rows = [], []
    for day in range(3):
        close = 50 + np.cumsum(rng.normal(0, 1, 40))
        for i in range(40):
            high, low = float(close[i] + rng.random()), float(close[i] - rng.random())
            if day == 2:
                high = low = close[i] = 7.0  # flat: no ranges, no changes
            bars.append(("A", f"2024-01-0{day + 1}", i, float(close[i]), high, low, float(close[i]), int(rng.integers(0 if day == 2 else 1, 9))))
    frame = spark.createDataFrame(bars, "symbol string, session_date string, slot int, open double, high double, low double, close double, volume long").withColumn("session_date", F.to_date("session_date"))
    want = {(str(r.session_date), r.slot): r for r in features.feature_frame(frame).collect()}
    fired = {(r.strategy_id, str(r.session_date), r.slot) for r in rules.signals(features.feature_frame(frame), RULES, ("session_date", "slot")).collect()}
    found = set()
    for day in sorted({b[1] for b in bars}):
        state = SessionFeatures([], 0, 0.0, 0.0, 0.0, 0.0)
        for b in bars:
            if b[1] == day:
                own = state.add(b[4], b[5], b[6], b[7])
                for name, value in own.items():
                    expected = want[day, b[2]][name]
                    assert (value is None) == (expected is None) and (value is None or value == pytest.approx(expected, rel=1e-9, abs=1e-9)), (day, b[2], name)
                found |= {(k, day, b[2]) for k, rule in RULES.items() if holds(rule, own)}
        assert len(state.bars) == 20
    assert found == fired and len(found) > 10


def test_states_do_not_depend_on_the_runs(spark):
    kinds = ["enter", "fill", "exit", "fill", "odd", "enter", "reject", "enter", "enter", "fill", "exit", "reject", "exit", "fill", "close", "enter"]
    rows = [("s", f"u{u}", "1970-01-02", 86_400 + 100 * u + 250 * i, i, kind) for u in range(3) for i, kind in enumerate(kinds)]
    rows += [("s", "late", "1970-01-04", 4 * 86_400 - 1, 0, "enter")]
    frame = spark.createDataFrame(rows, "strategy_id string, symbol string, session string, t long, n int, event string").withColumn("ts", F.timestamp_seconds("t"))
    run = lambda parts: stream_queries._runs(spark, parts, lambda s: sessions.strategy_states(s, 600, 2))
    one = run([frame])
    three = run([frame.where("t < 87600"), frame.where("t >= 87600 AND t < 89000"), frame.where("t >= 89000")])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(one) == key(three)
    own = [(r.t, r.event, r.outcome, r.from_phase, r.to_phase, r.entries) for r in one.where("symbol = 'u0'").orderBy("t", F.col("event") != "cooldown_elapsed").collect()]
    assert own[:5] == [(86_400, "enter", "accepted", "FLAT", "ENTRY_PENDING", 0), (86_650, "fill", "accepted", "ENTRY_PENDING", "LONG", 1), (86_900, "exit", "accepted", "LONG", "EXIT_PENDING", 1), (87_150, "fill", "accepted", "EXIT_PENDING", "COOLDOWN", 1), (87_400, "odd", "refused", "COOLDOWN", "COOLDOWN", 1)]
    assert (87_750, "cooldown_elapsed", "accepted", "COOLDOWN", "FLAT", 1) in own
    assert own[-1] == (90_150, "enter", "refused", "SESSION_CLOSED", "SESSION_CLOSED", 2)
    assert not one.where("symbol = 'late' AND event = 'session_end'").count()


def test_states_do_not_depend_on_the_buckets(spark):
    rows = [("s", f"u{u}", "1970-01-02", 86_400 + 10 * u + 700 * i, i, kind) for u in range(40) for i, kind in enumerate(["enter", "fill", "exit", "fill", "enter", "fill"])]
    frame = spark.createDataFrame([*rows, ("s", "late", "1970-01-04", 4 * 86_400 - 1, 0, "enter")], "strategy_id string, symbol string, session string, t long, n int, event string").withColumn("ts", F.timestamp_seconds("t"))
    run = lambda buckets: sorted(map(tuple, stream_queries._runs(spark, [frame.where("t < 88600"), frame.where("t >= 88600")], lambda s: sessions.strategy_states(s, 600, 2, buckets=buckets)).collect()))
    one = run(1)
    assert one == run(7)
    ends = [r for r in one if r[4] == "session_end"]  # each symbol of a bucket has its own
    assert len(ends) == 40 and {(r[3], r[6], r[8]) for r in ends} == {(2 * 86_400, "LONG", 2)}
    assert len([r for r in one if r[4] == "cooldown_elapsed"]) == 40


def test_checked_sink(spark, tmp_path):
    schema = "k long, day string, v string"
    where = str(tmp_path / "sink")

    def deliver(rows, name):
        source = str(tmp_path / f"in-{uuid.uuid4().hex}")
        spark.createDataFrame(rows, schema).write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sessions.append_checked(stream, where, str(tmp_path / name), ["k"], "day", 2)

    state = lambda part: sorted((r.k, r.v) for r in sessions.read_sink(spark, where, spark.createDataFrame([], schema).schema, part).collect())
    deliver([(1, "a", "x"), (2, "a", None)], "one")
    deliver([(1, "a", "x"), (2, "a", None), (3, "b", "y"), (3, "b", "y")], "two")
    assert state("rows") == [(1, "x"), (2, None), (3, "y")] and state("conflicts") == []
    deliver([(1, "a", "z"), (2, "a", "w"), (4, "c", "q")], "three")
    assert state("rows") == [(1, "x"), (2, None), (3, "y"), (4, "q")] and state("conflicts") == [(1, "z"), (2, "w")]
    # a batch that runs again, as after a crash between its write and its commit, changes nothing
    import shutil

    shutil.rmtree(tmp_path / "three")
    deliver([(1, "a", "z"), (2, "a", "w"), (4, "c", "q")], "three")
    assert state("rows") == [(1, "x"), (2, None), (3, "y"), (4, "q")] and state("conflicts") == [(1, "z"), (2, "w")]
    # a batch reads only the partitions that it falls into
    there = sessions.read_sink(spark, where, spark.createDataFrame([], schema).schema)
    plan = there.where("day = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
