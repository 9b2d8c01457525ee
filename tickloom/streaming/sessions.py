"""State of strategies, signals and feeds on streams, and a sink with conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import rules as rule_operators

# Phases of a strategy in a session, and to which phase each event leads from which phases.
FLAT, ENTRY_PENDING, LONG, EXIT_PENDING, COOLDOWN, CLOSED = "FLAT", "ENTRY_PENDING", "LONG", "EXIT_PENDING", "COOLDOWN", "SESSION_CLOSED"
MOVES = {
    "enter": {FLAT: ENTRY_PENDING},
    "fill": {ENTRY_PENDING: LONG, EXIT_PENDING: COOLDOWN},
    "exit": {LONG: EXIT_PENDING},
    "reject": {ENTRY_PENDING: FLAT, EXIT_PENDING: LONG},
    "close": {p: CLOSED for p in (FLAT, ENTRY_PENDING, LONG, EXIT_PENDING, COOLDOWN)},
}
# What a feed's health names.
MISSING, GAP, STALE = "REQUIRED_SYMBOL_STREAM_MISSING", "MARKET_DATA_GAP", "MARKET_DATA_STALE"

TRANSITIONS = "strategy_id string, symbol string, session string, t long, event string, outcome string, from_phase string, to_phase string, entries int"


class StrategyState(StatefulProcessor):
    """A strategy's phase, entries and cooldown in each symbol of a session; every event gives a transition that is accepted or refused.

    An exit's fill starts a cooldown, which ends when an event of the session comes at its end or later, or when the watermark passes it: both
    give the same row, at the cooldown's end. When the watermark passes the session's end, an open session closes, and its state goes.

    A key is a bucket of a session's symbols: a call of the state costs far more than an event, so one call serves all symbols of a bucket. The
    bucket has one timer, at the first time at which something of one of its symbols ends.
    """

    def __init__(self, cooldown_s: int, most_entries: int, session_s: int = 86_400):
        self.cooldown_s, self.most, self.session_s = cooldown_s, most_entries, session_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer long, symbol array<string>, phase array<string>, entries array<int>, until array<long>, ends array<long>")

    def _read(self) -> tuple[int, dict]:
        """The bucket's timer, and of each symbol its phase, entries, cooldown's end and session's end."""
        if not self.state.exists():
            return 0, {}
        timer, symbols, *columns = self.state.get()
        return timer, {symbol: list(own) for symbol, *own in zip(symbols, *columns, strict=True)}

    def _write(self, timer: int, known: dict) -> None:
        if not known:
            self.state.clear()
            return
        due = min(self._due(*own) for own in known.values()) * 1000
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((due, list(known), *(list(c) for c in zip(*known.values(), strict=True))))

    @staticmethod
    def _due(phase: str, _: int, until: int, ends: int) -> int:
        return min(until, ends) if phase == COOLDOWN else ends

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events: dict = {}
        for part in rows:
            for symbol, *event in part[["symbol", "t", "n", "event"]].itertuples(index=False, name=None):
                events.setdefault(symbol, []).append(tuple(event))
        timer, known = self._read()
        out = []
        for symbol, own in events.items():
            known[symbol] = self._moved((key[0], symbol, key[1]), sorted(own), known.get(symbol), out)
        self._write(timer, known)
        yield self._frame(out)

    def _moved(self, names: tuple, events: list[tuple], before: list | None, out: list) -> list:
        """A symbol's state after its events; their transitions go to out."""
        phase, entries, until, ends = before or (FLAT, 0, 0, 0)

        def moved(t: int, event: str, to: str | None) -> None:
            nonlocal phase
            out.append((*names, t, event, "refused" if to is None else "accepted", phase, phase if to is None else to, entries))
            phase = phase if to is None else to

        for t, _, event in events:
            if not ends:
                ends = t - t % self.session_s + self.session_s
            if phase == COOLDOWN and t >= until:
                moved(until, "cooldown_elapsed", FLAT)
            to = MOVES.get(event, {}).get(phase)
            if event == "enter" and to and entries >= self.most:
                to = None
            if to == LONG and phase == ENTRY_PENDING:
                entries += 1
            if to == COOLDOWN:
                until = t + self.cooldown_s
            moved(t, event, to)
        return [phase, entries, until, ends]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        timer, known = self._read()
        out, left = [], {}
        for symbol, (phase, entries, until, ends) in known.items():
            if phase == COOLDOWN and until <= ends and until * 1000 <= at:
                out.append((key[0], symbol, key[1], until, "cooldown_elapsed", "accepted", phase, FLAT, entries))
                phase = FLAT
            if ends * 1000 > at:
                left[symbol] = [phase, entries, until, ends]
            elif phase != CLOSED:
                out.append((key[0], symbol, key[1], ends, "session_end", "accepted", phase, CLOSED, entries))
        self._write(0 if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, left)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def close(self) -> None:
        pass


def strategy_states(events: DataFrame, cooldown_s: int, most_entries: int, late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """Transitions of a stream of events: strategy_id, symbol, session (text), ts, t (seconds), n (breaks ties of t), event (a key of MOVES;
    any other is refused). Events of one symbol and session count in the order of (t, n) within a batch; a batch must not hold events before an
    earlier one's. The symbols of a session are dealt into buckets, each with one state; the result does not depend on their number."""
    keyed = events.withWatermark("ts", late).withColumn("bucket", bucket(["symbol"], buckets)).groupBy("strategy_id", "session", "bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=StrategyState(cooldown_s, most_entries), outputStructType=TRANSITIONS, outputMode="append", timeMode="eventTime")


def holds(rule: dict, row: dict) -> bool:
    """A rule's truth for one row of features, as rules.condition has it for columns."""
    if "all" in rule or "any" in rule:
        return (all if "all" in rule else any)(holds(r, row) for r in rule.get("all", rule.get("any")))
    x = row[rule["indicator"]]
    return x is not None and x - x == 0 and getattr(float(x), rule_operators.COMPARISONS[rule["op"]])(float(rule["value"]))


class SessionFeatures:
    """The indicators of features.feature_frame for one session, bar after bar, from its last 20 bars and a few sums."""

    FAST, SLOW, WIDE, LONG = 3, 8, 14, 20

    def __init__(self, bars: list[tuple], n: int, fast: float, slow: float, value: float, volume: float):
        self.bars, self.n, self.fast, self.slow, self.value, self.volume = bars, n, fast, slow, value, volume

    def add(self, high: float, low: float, close: float, volume: int) -> dict:
        """Take a bar (high, low, close, volume) in; its indicators. What lacks bars, or divides by zero, is None."""
        before = [b[2] for b in self.bars[-self.FAST :]]
        self.bars = [*self.bars, (high, low, close, volume)][-self.LONG :]
        self.n += 1
        share = lambda span: 2.0 / (span + 1)
        self.fast = close if self.n == 1 else self.fast * (1.0 - share(self.FAST)) + close * share(self.FAST)
        self.slow = close if self.n == 1 else self.slow * (1.0 - share(self.SLOW)) + close * share(self.SLOW)
        self.value += (high + low + close) / 3.0 * volume
        self.volume += volume
        over = lambda a, b: None if a is None or b is None or b == 0 else a / b
        less = lambda x: None if x is None else x - 1
        out = {"return_1": less(over(close, before[-1] if before else None)), "return_3": less(over(close, before[0] if len(before) == self.FAST else None))}
        out["ema_spread"] = less(over(self.fast, self.slow)) if self.n >= self.SLOW else None
        closes = [b[2] for b in self.bars]
        changes = [b - a for a, b in zip(closes, closes[1:], strict=False)][-self.WIDE :]
        out["rsi"] = None
        if len(changes) == self.WIDE:
            gain, loss = sum(max(c, 0.0) for c in changes) / self.WIDE, sum(max(-c, 0.0) for c in changes) / self.WIDE
            out["rsi"] = 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100.0 - 100.0 / (1 + gain / loss)
        out["atr_bps"] = None
        if self.n >= self.WIDE:
            last = self.bars[-self.WIDE :]
            ahead = self.bars[-self.WIDE - 1][2] if self.n > self.WIDE else None
            ranges = []
            for h, low_, c, _ in last:
                ranges.append(h - low_ if ahead is None else max(h - low_, abs(h - ahead), abs(low_ - ahead)))
                ahead = c
            out["atr_bps"] = over(sum(ranges) / self.WIDE, close)
            out["atr_bps"] = None if out["atr_bps"] is None else out["atr_bps"] * 10_000
        out["volume_ratio"] = over(volume, sum(b[3] for b in self.bars) / self.LONG) if self.n >= self.LONG else None
        away = less(over(close, over(self.value, self.volume)))
        out["vwap_distance_bps"] = None if away is None else away * 10_000
        out["range_position"] = 0.5 if high == low == close else over(close - low, high - low)
        return out


class SignalState(StatefulProcessor):
    """The bars of one symbol and session so far; each new bar gives the rules that it satisfies. A bar not after the last one is passed over."""

    def __init__(self, rules: dict[str, dict]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "high double, low double, close double, volume long")
        self.sums = handle.getValueState("sums", "t long, n int, fast double, slow double, value double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(x for part in rows for x in part[["t", "slot", "high", "low", "close", "volume"]].itertuples(index=False, name=None))
        last, *sums = self.sums.get() if self.sums.exists() else (-1, 0, 0.0, 0.0, 0.0, 0.0)
        state, out = SessionFeatures([tuple(b) for b in self.bars.get()] if sums[0] else [], *sums), []
        for t, slot, high, low, close, volume in new:
            if t > last:
                last, row = t, state.add(high, low, close, volume)
                out += [(name, key[0], key[1], slot) for name, rule in sorted(self.rules.items()) if holds(rule, row)]
        self.bars.put([(float(a), float(b), float(c), int(d)) for a, b, c, d in state.bars])
        self.sums.update((int(last), state.n, float(state.fast), float(state.slow), float(state.value), float(state.volume)))
        yield pd.DataFrame(out, columns=["strategy_id", "symbol", "session", "slot"])

    def close(self) -> None:
        pass


def signals(bars: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(strategy_id, symbol, session, slot) of the bars that satisfy each rule, from a stream of bars (symbol, session, t, slot, high, low, close,
    volume). State is at most 20 bars for a symbol and session; the rows are those of features.feature_frame and rules.signals over all bars."""
    return bars.groupBy("symbol", "session").transformWithStateInPandas(statefulProcessor=SignalState(rules), outputStructType="strategy_id string, symbol string, session string, slot int", outputMode="append", timeMode="none")


class FeedState(StatefulProcessor):
    """Health of one symbol's feed. A required symbol is known from the start: it is missing if its timer ends before its first bar. A
    feed is stale if no bar comes for stale_ms of processing time, and has a gap where two bars lie more than gap_s apart."""

    def __init__(self, gap_s: int, stale_ms: int):
        self.gap_s, self.stale_ms = gap_s, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "latest long, gaps int, timer long")

    def _wait(self, latest: int, gaps: int, timer: int, now: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.stale_ms)
        self.state.update((latest, gaps, now + self.stale_ms))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._wait(-1, 0, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, gaps, timer = self.state.get() if self.state.exists() else (-1, 0, 0)
        out = []
        for t in sorted(t for part in rows for t in part["t"].tolist()):
            if latest >= 0 and t - latest > self.gap_s:
                gaps += 1
                if gaps == 1:
                    out.append((key[0], GAP))
            latest = max(latest, t)
        self._wait(latest, gaps, timer, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["symbol", "code"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest, gaps, _ = self.state.get() if self.state.exists() else (-1, 0, 0)
        self.state.update((latest, gaps, 0))
        yield pd.DataFrame([(key[0], STALE if latest >= 0 else MISSING)], columns=["symbol", "code"])

    def close(self) -> None:
        pass


def feed_codes(rows: DataFrame, required: DataFrame, gap_s: int, stale_ms: int) -> DataFrame:
    """(symbol, code) as a stream: MISSING, GAP (the first one of a symbol) and STALE, from a stream of bars (symbol, t in seconds) and a table of
    required symbols."""
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=FeedState(gap_s, stale_ms), outputStructType="symbol string, code string", outputMode="append", timeMode="processingTime", initialState=required.groupBy("symbol"))


def bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def append_checked(stream: DataFrame, path: str, checkpoint: str, keys: list[str], within: str, buckets: int = 8) -> None:
    """Append a stream to a sink that holds one row for each key. A row that is there already adds nothing; one with the same key but other
    content goes to the conflicts beside the sink, with the batch that brought it.

    The sink is partitioned by `within` (a column that is a part of the key, such as the day) and by a hash of the key, and a batch reads
    only the partitions that its rows fall into: its work follows the batch, not the sink. Rows are named by their batch in the path, and a batch
    that is replayed writes its own path anew, so neither a crash nor a repeat doubles a row. Of unlike new rows of one key
    the one with the smallest content hash is kept.
    """
    spark, names = stream.sparkSession, sorted(stream.columns)
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def write(batch: DataFrame, number: int) -> None:
        own = f"{name}-{number}"
        rows = batch.select(*names, bucket(keys, buckets).alias("bucket"), F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("content")).dropDuplicates([*keys, "content"]).persist()
        try:
            touched = [(r[0], r[1]) for r in rows.select(F.col(within).cast("string"), "bucket").distinct().collect()]  # partitions, not rows
            there = read_sink(spark, path, stream.schema)
            there = there.where(F.col("batch") != own)
            if touched:
                there = there.where(F.col(within).cast("string").isin(sorted({w for w, _ in touched})) & F.col("bucket").isin(sorted({b for _, b in touched})))
            known = there.select(*keys, F.col("content").alias("_there"))
            first = rows.groupBy(*keys).agg(F.min("content").alias("_first"))
            judged = rows.join(first, keys).join(known, keys, "left").withColumn("_there", F.coalesce("_there", "_first"))
            new = judged.where((F.col("content") == F.col("_there"))).join(known.select(*keys), keys, "left_anti")
            odd = judged.where(F.col("content") != F.col("_there"))
            spark_write(new.select(*names, "bucket", "content"), f"{path}/rows", own, within)
            spark_write(odd.select(*names, "bucket", "content"), f"{path}/conflicts", own, within)
        finally:
            rows.unpersist()

    for part in ("rows", "conflicts"):
        spark_write(spark.createDataFrame([], stream.schema).select(*names, F.lit(0).alias("bucket"), F.lit("").alias("content")), f"{path}/{part}", "none", within)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spark_write(rows: DataFrame, path: str, batch: str, within: str) -> None:
    """Write a batch's rows to its own folder in each partition, in place of what an earlier attempt at the batch left."""
    out = rows.select("*", F.lit(batch).alias("batch")).repartition(within, "bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(within, "bucket", "batch").parquet(path)


def read_sink(spark: SparkSession, path: str, schema, part: str = "rows") -> DataFrame:
    """A sink's rows (or its conflicts) with bucket, content and batch."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{columns}, bucket int, content string, batch string").parquet(f"{path}/{part}")
