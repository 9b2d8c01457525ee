"""Null tests against plain loops."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from tickloom.operators import nulls, trades

DAY = dt.date(2024, 1, 2)
SCHEMA = "strategy_id string, symbol string, session_date date, opportunity_id long, signal_s long, entry_s long, exit_s long, entered boolean, profit long"


def make(seed, n=90):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        signal = int(rng.integers(0, 400))
        entry = signal + int(rng.integers(0, 5))
        out.append((f"s{i % 2}", "ABC"[int(rng.integers(3))], DAY + dt.timedelta(int(rng.integers(2))), i * 7919 % 10_007, signal, entry, entry + int(rng.integers(0, 60)), bool(rng.random() < 0.4), int(rng.integers(-500, 500))))
    return out


def plain_draw(i, rep, seed):
    x = i % nulls.PRIME
    for add in nulls.ROUNDS:
        x = pow((x + rep + seed + add) % nulls.PRIME, 5, nulls.PRIME)
    return x


def plain_score(rows, cooldown, most, most_open):
    """(profit, accepted, rejected) of marked rows of all sessions, in time order."""
    profit = accepted = rejected = 0
    for day in {r[2] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[2] == day), key=lambda r: (r[5], r[1], r[4], r[3])):
            own = [x for s, x in taken if s == r[1]]
            if len(taken) < most and sum(x > r[5] for _, x in taken) < most_open and (not own or r[5] >= own[-1] + cooldown):
                taken.append((r[1], r[6]))
                accepted, profit = accepted + 1, profit + r[8]
            else:
                rejected += 1
    return profit, accepted, rejected


def plain_scores(rows, reps, cooldown, most, most_open, seed):
    out = {}
    for strategy in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == strategy]
        groups = {}
        for r in own:
            groups.setdefault((r[1], r[2]), []).append(r)
        out[strategy, nulls.OBSERVED, 0] = plain_score([r for r in own if r[7]], cooldown, most, most_open)
        for rep in range(reps):
            dealt, moved = [], []
            for (symbol, day), group in groups.items():
                group.sort(key=lambda r: (r[4], r[3]))
                marks = sum(r[7] for r in group)
                dealt += sorted(group, key=lambda r: (plain_draw(r[3], rep, seed), r[3]))[:marks]
                by = int(hashlib.md5(f"shift|{seed}|{rep}|{strategy}|{symbol}|{day}".encode()).hexdigest()[:15], 16) % (len(group) - 1) + 1 if len(group) > 1 else 0
                moved += [group[(i + by) % len(group)] for i, r in enumerate(group) if r[7]]
            out[strategy, nulls.PERMUTED, rep] = plain_score(dealt, cooldown, most, most_open)
            out[strategy, nulls.SHIFTED, rep] = plain_score(moved, cooldown, most, most_open)
    return out


@pytest.mark.parametrize(("reps", "cooldown", "most", "most_open", "seed", "blocks"), [(7, 0, 100, 3, 0, 4), (5, 30, 6, 1, 9, 1), (3, 10, 4, 2, 5, 8)])
def test_scores_equal_loops(spark, reps, cooldown, most, most_open, seed, blocks):
    rows = make(seed)
    got = nulls.null_scores(spark.createDataFrame(rows, SCHEMA), reps, cooldown, most, most_open, seed, blocks).collect()
    assert {(r.strategy_id, r.method, r.rep): (r.profit, r.accepted, r.rejected) for r in got} == plain_scores(rows, reps, cooldown, most, most_open, seed)


def test_edges_of_scores(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nulls.null_scores(empty, 3).count() == 0 and nulls.faults(empty).count() == 0
    row = ("s", "A", DAY, 1, 5, 5, 9, True, 10)
    idle = ("t", "A", DAY, 2, 5, 5, 9, None, 10)
    one = nulls.null_scores(spark.createDataFrame([row, idle], SCHEMA), 2).collect()  # a group of one keeps its mark
    assert {(r.strategy_id, r.profit, r.accepted, r.rejected) for r in one} == {("s", 10, 1, 0)} and len(one) == 5
    codes = {(r.strategy_id, r.code, r.n) for r in nulls.faults(spark.createDataFrame([row, idle, ("s", "B", DAY, 3, 9, 8, 9, False, 1), ("s", "B", DAY, 4, 9, 9, 9, True, 1)], SCHEMA)).collect()}
    assert codes == {("s", "UNSHIFTABLE_GROUP", 1), ("t", "NOTHING_ENTERED", 1), ("s", "DUPLICATE_SIGNAL_SLOT", 1), ("s", "NOT_CHRONOLOGICAL", 1)}


def test_draws_spread_evenly():
    x = nulls.draws(np.arange(2000), np.arange(50), 3)
    assert len(np.unique(x)) > 99_990
    top = np.argsort(x, axis=0)[:200]  # a tenth of the ids in each repetition, no id much more often than another
    counts = np.bincount(top.ravel(), minlength=2000)
    assert 4 < counts.mean() < 6 and counts.max() < 20


def test_acceptance_equals_loop(spark):
    rows = make(4, 150)
    entries = spark.createDataFrame([(r[0], r[2], r[1], r[3], r[5], r[6], "x") for r in rows], "strategy_id string, session_date date, symbol string, entry_id long, entry_s long, exit_s long, accepted string")
    got = {(r.strategy_id, r.entry_id): r.accepted for r in trades.accept_entries(entries, 20, 9, 2).collect()}
    for strategy, day in {(r[0], r[2]) for r in rows}:
        taken = []
        for r in sorted((r for r in rows if (r[0], r[2]) == (strategy, day)), key=lambda r: (r[5], r[1], r[3])):
            own = [x for s, x in taken if s == r[1]]
            ok = len(taken) < 9 and sum(x > r[5] for _, x in taken) < 2 and (not own or r[5] >= own[-1] + 20)
            assert got[strategy, r[3]] == ok
            if ok:
                taken.append((r[1], r[6]))


def test_touches_and_exits_equal_loops(spark):
    rng = np.random.default_rng(2)
    at = lambda i: dt.datetime(2024, 1, 2) + dt.timedelta(minutes=int(i))
    prices = {s: 100 + np.cumsum(rng.normal(0, 1, 120)) for s in "AB"}
    bars = [(s, DAY, at(i), float(p[i] - 0.5), float(p[i] + 0.5), float(p[i])) for s, p in prices.items() for i in range(120)]
    orders = [(["A", "B", "C"][k % 3], DAY, k, at(rng.integers(0, 120)), ["buy", "sell"][k % 2], float(100 + rng.normal(0, 4))) for k in range(300)] + [("A", DAY, 999, at(3), "buy", None)]
    frame = spark.createDataFrame(bars, "symbol string, session_date date, bar_start timestamp, low double, high double, close double")
    got = {r.order_id: r.fill_time for r in trades.limit_fills(spark.createDataFrame(orders, "symbol string, session_date date, order_id long, signal_time timestamp, side string, limit_price double"), frame).collect()}
    for s, _, k, t, side, limit in orders:
        hits = [b[2] for b in bars if b[0] == s and b[2] > t and limit is not None and (b[3] <= limit if side == "buy" else b[4] >= limit)]
        assert got[k] == (min(hits) if hits else None)
    entries = [(s, DAY, k, t, limit) for s, _, k, t, _, limit in orders if limit]
    found = {r.entry_id: (r.exit_time, r.exit_reason, r.exit_price) for r in trades.exits(spark.createDataFrame(entries, "symbol string, session_date date, entry_id long, entry_time timestamp, entry_price double"), frame, 300, 200, 40).collect()}
    for s, _, k, t, price in entries:
        path = [b for b in bars if b[0] == s and b[2] > t]
        want = None
        for b in path:
            reason = "stop_loss" if b[5] <= price * (1 - 300 / 10_000) else "take_profit" if b[5] >= price * (1 + 200 / 10_000) else "max_holding" if b[2] - t >= dt.timedelta(minutes=40) else "session_close" if b is path[-1] else None
            if reason:
                want = (b[2], reason, b[5])
                break
        assert found.get(k) == want


def test_opportunities_read_no_rest_of_a_session_for_each_tick(spark):
    from tickloom.plans import null_queries

    plan = null_queries.opportunities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "specifiedwindowframe(rowframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_entries_met_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    n, many = 21, 1500
    marks = rng.random((many, n)) < 0.3
    entries = np.sort(rng.integers(0, 40_000, many)).tolist()
    rows = [("ABC"[i % 3], e, e + int(rng.integers(0, 90)), int(rng.integers(-50, 50))) for i, e in enumerate(entries)]
    one, all_ = nulls.Scores(n, 60, 9, 2), nulls.Scores(n, 60, 9, 2)
    for row, marked in zip(rows, marks, strict=True):
        one.meet(*row, marked)
    met, meet = [], nulls.Scores.meet
    monkeypatch.setattr(nulls.Scores, "meet", lambda self, *a: (met.append(1), meet(self, *a)))
    all_.meet_all(*map(list, zip(*rows, strict=True)), [x.tobytes() for x in np.packbits(marks, axis=1)])
    for name in ("profit", "accepted", "rejected"):
        assert (getattr(one, name) == getattr(all_, name)).all()
    assert len(met) <= nulls.STEP  # all repetitions are full after that
