"""Null tests that obey the trading rules: entered marks are dealt anew, and every repetition is scored entry by entry.

An opportunity is an entry that could have been made, with its fixed exit and profit: strategy_id, symbol, session_date, opportunity_id (an
integer), signal_s, entry_s and exit_s (seconds of the session), entered, profit. The marks of a symbol and session are dealt among its
opportunities; a session's entries, over all its symbols, are then accepted or rejected in time order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERMUTED, SHIFTED, OBSERVED = "SESSION_SIGNAL_PERMUTATION", "SESSION_SAFE_TIMESTAMP_SHIFT", "OBSERVED"
#: Draws are numbers below this prime; x ** 5 permutes them.
PRIME = 2**31 - 1
#: Added before each power, besides the repetition.
ROUNDS = (1_013_904_223, 1_664_525, 22_695_477, 1_103_515_245)
#: Draws made together.
CELLS = 2_000_000
NEVER = -(2**62)
#: Entries whose bits are unpacked together.
STEP = 512


def draws(ids: np.ndarray, repetitions: np.ndarray, seed: int) -> np.ndarray:
    """A number for each id (rows) and repetition (columns), well mixed, by integers that SQL has, too."""
    x = np.add.outer(ids % PRIME, np.zeros(len(repetitions), np.int64))
    key = (repetitions + seed % PRIME) % PRIME
    for add in ROUNDS:
        x = (x + key + add) % PRIME
        square = x * x % PRIME
        x = square * square % PRIME * x % PRIME
    return x


def draw_sql(identity: str, repetition: str, seed: int) -> str:
    """draws as SQL over 64-bit integers."""
    x = f"({identity} % {PRIME})"
    for add in ROUNDS:
        x = f"(SELECT (s * s % {PRIME}) * x % {PRIME} FROM (SELECT x, x * x % {PRIME} AS s FROM (SELECT ({x} + ({repetition} + {seed % PRIME}) % {PRIME} + {add}) % {PRIME} AS x)))"
    return x


def offset(seed: int, repetition: int, size: int, *key: str) -> int:
    """By how many places, 1 to size - 1, a repetition moves a group's marks."""
    text = "|".join(["shift", str(seed), str(repetition), *key])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % (size - 1) + 1


def faults(opportunities: DataFrame) -> DataFrame:
    """(strategy_id, symbol, session, code, n): groups that can't be tested, as all their opportunities are entered; signal times that
    a group has twice; and opportunities whose times are out of order. A strategy without any entered opportunity is NOTHING_ENTERED."""
    key = ["strategy_id", "symbol", "session_date"]
    by = opportunities.groupBy(*key).agg(F.count("*").alias("slots"), F.count_if("entered").alias("marks"), F.countDistinct("signal_s").alias("times"), F.count_if(~((F.col("signal_s") <= F.col("entry_s")) & (F.col("entry_s") <= F.col("exit_s")))).alias("odd"))
    found = F.array_compact(
        F.array(
            F.when(F.col("marks") >= F.col("slots"), F.struct(F.lit("UNSHIFTABLE_GROUP").alias("code"), F.col("slots").alias("n"))),
            F.when(F.col("times") < F.col("slots"), F.struct(F.lit("DUPLICATE_SIGNAL_SLOT").alias("code"), (F.col("slots") - F.col("times")).alias("n"))),
            F.when(F.col("odd") > 0, F.struct(F.lit("NOT_CHRONOLOGICAL").alias("code"), F.col("odd").alias("n"))),
        )
    )
    rows = by.select("strategy_id", "symbol", F.col("session_date").cast("string").alias("session"), F.explode(found).alias("f")).select("strategy_id", "symbol", "session", "f.*")
    idle = by.groupBy("strategy_id").agg(F.sum("marks").alias("marks"), F.sum("slots").alias("n")).where("marks = 0")
    return rows.unionByName(idle.select("strategy_id", F.lit("").alias("symbol"), F.lit("").alias("session"), F.lit("NOTHING_ENTERED").alias("code"), "n"))


def masks(opportunities: DataFrame, repetitions: int, seed: int = 0, blocks: int = 4) -> DataFrame:
    """The entered marks of every repetition: a row for each opportunity that has one, and each block of repetitions, with a bit for each.

    A block's bits are those of its permutations, then of its shifts, then (in block 0) the true mark. A group is one symbol and session,
    so it is as large as a session has signal times; groups without a mark give no rows. A group of one keeps its mark.
    """
    size = -(-repetitions // blocks)

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([("signal_s", "ascending"), ("opportunity_id", "ascending")])
        entered = table["entered"].to_numpy().astype(bool)
        n, marks = len(entered), int(entered.sum())
        if not marks:
            return kept.empty_table()
        ids = table["opportunity_id"].to_numpy().astype(np.int64)
        by_id = np.argsort(ids, kind="stable")
        key = [str(table[c][0].as_py()) for c in ("strategy_id", "symbol", "session_date")]
        rows, bits = [], []
        for block in range(blocks):
            reps = np.arange(block * size, min((block + 1) * size, repetitions))
            if not len(reps) and block:
                continue
            dealt = np.zeros((n, len(reps)), bool)
            step = max(1, CELLS // n)
            for at in range(0, len(reps), step):
                order = np.argsort(draws(ids[by_id], reps[at : at + step], seed), axis=0, kind="stable")[:marks]
                np.put_along_axis(dealt[:, at : at + step], by_id[order], True, axis=0)
            moved = np.stack([np.roll(entered, offset(seed, int(r), n, *key)) if n > 1 else entered for r in reps], axis=1) if len(reps) else np.zeros((n, 0), bool)
            own = np.concatenate([dealt, moved, *([entered[:, None]] if block == 0 else [])], axis=1)
            some = np.flatnonzero(own.any(axis=1))
            rows.append((block, some))
            bits += [x.tobytes() for x in np.packbits(own[some], axis=1)]
        take = np.concatenate([s for _, s in rows])
        out = table.select(["strategy_id", "symbol", "session_date", "opportunity_id", "signal_s", "entry_s", "exit_s", "profit"]).take(pa.array(take))
        number = np.concatenate([np.full(len(s), b, np.int32) for b, s in rows])
        return out.append_column("block", pa.array(number)).append_column("mask", pa.array(bits, pa.binary()))

    columns = {"strategy_id": "string", "symbol": "string", "session_date": "date", "opportunity_id": "long", "signal_s": "long", "entry_s": "long", "exit_s": "long", "profit": "long"}
    kinds = {"string": pa.string(), "date": pa.date32(), "long": pa.int64()}
    kept = pa.schema([*((c, kinds[k]) for c, k in columns.items()), ("block", pa.int32()), ("mask", pa.binary())])
    rows = opportunities.select(*[F.col(c).cast(k).alias(c) for c, k in columns.items()], F.coalesce("entered", F.lit(False)).alias("entered"))
    schema = ", ".join(f"{c} {k}" for c, k in columns.items()) + ", block int, mask binary"
    return rows.groupBy("strategy_id", "symbol", "session_date").applyInArrow(deal, schema)


def profits(opportunities: DataFrame, repetitions: int, seed: int = 0) -> DataFrame:
    """(strategy_id, method, rep, profit): the summed profit of every repetition's marks, without any rule of trading. All repetitions of a row are
    added at once, from its bits."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for strategy, profit, mask in zip(*(batch.column(c).to_pylist() for c in ("strategy_id", "profit", "mask")), strict=True):
                own = total.setdefault(strategy, np.zeros(2 * repetitions + 1, np.int64))
                own[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).view(bool)] += profit
        method = pa.array([PERMUTED] * repetitions + [SHIFTED] * repetitions + [OBSERVED])
        for strategy, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([strategy] * len(own)), method, pa.array([*range(repetitions), *range(repetitions), 0], pa.int32()), pa.array(own)], ["strategy_id", "method", "rep", "profit"])

    rows = masks(opportunities, repetitions, seed, 1).select("strategy_id", "profit", "mask")
    return rows.mapInArrow(add, "strategy_id string, method string, rep int, profit long").groupBy("strategy_id", "method", "rep").agg(F.sum("profit").alias("profit"))


class Scores:
    """What many repetitions of one session have accepted so far; an entry is met by all of them at once."""

    def __init__(self, n: int, cooldown: int, most_entries: int, most_open: int):
        self.cooldown, self.most = cooldown, most_entries
        self.open = np.full((most_open, n), NEVER)  # exits of the open positions
        self.last: dict[str, np.ndarray] = {}
        self.n, self.profit, self.accepted, self.rejected = n, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def meet_all(self, symbols: list[str], entries: list[int], exits: list[int], profits: list[int], masks: list[bytes]) -> None:
        """Meet entries in order. Repetitions that have all their entries reject what comes, counted for many entries at once."""
        for begin in range(0, len(masks), STEP):
            packed = np.frombuffer(b"".join(masks[begin : begin + STEP]), np.uint8).reshape(-1, len(masks[begin]))
            marked = np.unpackbits(packed, axis=1, count=self.n).view(bool)
            full = self.accepted >= self.most
            if full.any():
                self.rejected[full] += marked[:, full].sum(axis=0)
                marked[:, full] = False
            for i in np.flatnonzero(marked.any(axis=1)).tolist():
                self.meet(symbols[begin + i], entries[begin + i], exits[begin + i], profits[begin + i], marked[i])

    def meet(self, symbol: str, entry: int, exit_: int, profit: int, marked: np.ndarray) -> None:
        last = self.last.get(symbol)
        if last is None:
            last = self.last[symbol] = np.full(self.n, NEVER)
        at = np.flatnonzero(marked)
        free = self.open[:, at].argmin(axis=0)  # the position that ends first
        ok = (self.open[free, at] <= entry) & (last[at] <= entry - self.cooldown) & (self.accepted[at] < self.most)
        self.rejected[at[~ok]] += 1
        at, free = at[ok], free[ok]
        self.accepted[at] += 1
        self.profit[at] += profit
        last[at] = exit_
        self.open[free, at] = exit_


def null_scores(opportunities: DataFrame, repetitions: int = 200, cooldown: int = 0, most_entries: int = 100, most_open: int = 3, seed: int = 0, blocks: int = 4) -> DataFrame:
    """(strategy_id, method, rep, profit, accepted, rejected): the observed entries (rep 0) and every repetition of both methods.

    An entry is rejected while its symbol is held or cools down (seconds after the exit), when its session has most_entries accepted ones, or
    while most_open positions are open. Sessions are read in time order, one entry at a time, so a task holds the state of one session and
    block of repetitions, whatever the session's size. The result does not depend on blocks. A strategy without entered opportunities has no
    rows; an empty table gives none.
    """
    size = -(-repetitions // blocks)
    order = ["entry_s", "symbol", "signal_s", "opportunity_id"]

    def score(batches) -> Iterator[pa.RecordBatch]:
        state, own = None, None

        def result() -> pa.RecordBatch:
            strategy, _, block = own
            reps = list(range(block * size, min((block + 1) * size, repetitions)))
            method = [PERMUTED] * len(reps) + [SHIFTED] * len(reps) + [OBSERVED] * (block == 0)
            number = reps + reps + [0] * (block == 0)
            return pa.RecordBatch.from_arrays([pa.array([strategy] * state.n), pa.array(method), pa.array(number, pa.int32()), pa.array(state.profit), pa.array(state.accepted), pa.array(state.rejected)], ["strategy_id", "method", "rep", "profit", "accepted", "rejected"])

        for batch in batches:
            begin = 0
            for key, same in groupby(zip(*(batch.column(c).to_pylist() for c in ("strategy_id", "session_date", "block")), strict=True)):
                if key != own:
                    if own is not None:
                        yield result()
                    n = 2 * (min((key[2] + 1) * size, repetitions) - key[2] * size) + (key[2] == 0)
                    own, state = key, Scores(n, cooldown, most_entries, most_open)
                part = batch.slice(begin, sum(1 for _ in same))
                begin += part.num_rows
                state.meet_all(*(part.column(c).to_pylist() for c in ("symbol", "entry_s", "exit_s", "profit", "mask")))
        if own is not None:
            yield result()

    key = ["strategy_id", "session_date", "block"]
    rows = masks(opportunities, repetitions, seed, blocks).repartition(*key).sortWithinPartitions(*key, *order)
    scored = rows.mapInArrow(score, "strategy_id string, method string, rep int, profit long, accepted long, rejected long")
    return scored.groupBy("strategy_id", "method", "rep").agg(*[F.sum(c).alias(c) for c in ("profit", "accepted", "rejected")])


def accepted(entries: DataFrame, cooldown: int, most_entries: int, most_open: int, keys: tuple[str, ...] = ("strategy_id", "session_date")) -> DataFrame:
    """entries with `accepted`, decided as null_scores does it. Columns: keys, symbol, entry_id, entry_s and exit_s (seconds).

    A task reads its sessions in time order and holds one session's state: the open positions' exits in order, and each symbol's last exit.
    """

    def decide(batches) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "symbol", "entry_s", "exit_s")]
            for *key, symbol, entry, exit_ in zip(*columns, strict=True):
                if key != own:
                    own, taken, held, last = key, 0, [], {}
                del held[: bisect_right(held, entry)]
                ok = taken < most_entries and len(held) < most_open and last.get(symbol, NEVER) <= entry - cooldown
                if ok:
                    taken += 1
                    insort(held, exit_)
                    last[symbol] = exit_
                out.append(ok)
            yield batch.append_column("accepted", pa.array(out, pa.bool_()))

    schema = entries.drop("accepted").withColumn("accepted", F.lit(True)).schema
    rows = entries.drop("accepted").repartition(*keys).sortWithinPartitions(*keys, "entry_s", "symbol", "entry_id")
    return rows.mapInArrow(decide, schema)
