"""One pass over the bars of each session, in time order, that settles what waits for a price.

Orders or entries and bars of a symbol and session are read together by time. What waits lies in heaps by its level, so a bar touches only
what it settles: n log n for a session of n rows, and a task holds what waits in one session.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _swept(waiting: DataFrame, bars: DataFrame, keys: tuple[str, ...], at: str, identity: str, values: dict[str, Column], prices: tuple[str, ...], found: str, make: Callable) -> DataFrame:
    """(keys, identity, found...) as a session's state settles it. waiting: keys, at, identity and values; bars: keys, bar_start and prices.

    A bar comes before what starts at the same time, so only later bars count. `make` gives a state with start(t, identity, values), bar(t,
    prices) and end(); the last two give rows (identity, ...).
    """
    kinds = dict(waiting.dtypes)
    left = waiting.select(*keys, F.unix_micros(at).alias("_t"), F.lit(1).alias("_side"), F.col(identity).alias("_id"), *[v.alias(k) for k, v in values.items()], *[F.lit(None).cast("double").alias(p) for p in prices])
    right = bars.select(*keys, F.unix_micros("bar_start").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[identity]).alias("_id"), *[F.lit(None).cast(t).alias(k) for k, t in left.select(*values).dtypes], *[F.col(p).cast("double").alias(p) for p in prices])
    rows = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "_t", "_side", "_id")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{identity} {kinds[identity]}", found])
    held = list(values)
    names = [*keys, identity, *(c.split()[0] for c in found.split(", "))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, state, out, types = None, None, [], None

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n)) for n, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            types = types or {**{k: batch.schema.field(k).type for k in keys}, identity: batch.schema.field("_id").type}
            for *key, t, side, name, a, b in zip(*(batch.column(k).to_pylist() for k in (*keys, "_t", "_side", "_id")), zip(*(batch.column(k).to_pylist() for k in held), strict=True), zip(*(batch.column(p).to_pylist() for p in prices), strict=True), strict=True):
                if key != own:
                    if state is not None:
                        out += [(*own, *x) for x in state.end()]
                    own, state = key, make()
                if side:
                    state.start(t, name, a)
                else:
                    out += [(*own, *x) for x in state.bar(t, b)]
            if len(out) > 5000:
                yield flush()
        if state is not None:
            out += [(*own, *x) for x in state.end()]
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


class _Limits:
    """Open limit orders: buys by falling limit, sells by rising."""

    def __init__(self):
        self.buys, self.sells, self.count = [], [], 0

    def start(self, t: int, name, values: tuple) -> None:
        side, limit = values
        if limit is None:
            return
        self.count += 1
        heappush(*((self.buys, (-limit, self.count, name)) if side == "buy" else (self.sells, (limit, self.count, name))))

    def bar(self, t: int, prices: tuple) -> Iterator[tuple]:
        low, high = prices
        while self.buys and low is not None and -self.buys[0][0] >= low:
            yield heappop(self.buys)[2], t
        while self.sells and high is not None and self.sells[0][0] <= high:
            yield heappop(self.sells)[2], t

    def end(self) -> Iterator[tuple]:
        return iter(())


def limit_touches(orders: DataFrame, bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, order_id, fill_time): the first bar after each order that touches its limit; orders that none touches have no row."""
    found = _swept(orders, bars, keys, "signal_time", "order_id", {"_kind": F.col("side"), "_limit": F.col("limit_price").cast("double")}, ("low", "high"), "fill_us long", _Limits)
    return found.select(*keys, "order_id", F.timestamp_micros("fill_us").alias("fill_time"))


class _Exits:
    """Open entries: by falling stop, by rising target, and in order of time. Each leaves the others' reach once it is settled."""

    def __init__(self, stop: float, take: float, hold_us: int):
        self.stop, self.take, self.hold = stop, take, hold_us
        self.stops, self.takes, self.times, self.open, self.last, self.count = [], [], deque(), {}, None, 0

    def start(self, t: int, name, values: tuple) -> None:
        (price,) = values
        self.count += 1
        self.open[self.count] = (name, t)
        self.times.append((t, self.count))
        if price is not None:
            heappush(self.stops, (-(price * (1 - self.stop / 10_000)), self.count))
            heappush(self.takes, (price * (1 + self.take / 10_000), self.count))
        if len(self.stops) > 2 * len(self.open) + 1000:  # what is settled otherwise goes
            for heap in (self.stops, self.takes):
                heap[:] = [x for x in heap if x[1] in self.open]
                heapify(heap)

    def _settled(self, number: int, t: int, close: float, reason: str) -> Iterator[tuple]:
        if number in self.open:
            yield self.open.pop(number)[0], t, reason, close

    def bar(self, t: int, prices: tuple) -> Iterator[tuple]:
        (close,) = prices
        self.last = (t, close)
        while self.stops and close is not None and -self.stops[0][0] >= close:
            yield from self._settled(heappop(self.stops)[1], t, close, "stop_loss")
        while self.takes and close is not None and self.takes[0][0] <= close:
            yield from self._settled(heappop(self.takes)[1], t, close, "take_profit")
        while self.times and t - self.times[0][0] >= self.hold:
            yield from self._settled(self.times.popleft()[1], t, close, "max_holding")

    def end(self) -> Iterator[tuple]:
        if self.last is not None:
            for name, t in self.open.values():
                if self.last[0] > t:
                    yield name, self.last[0], "session_close", self.last[1]


def exits(entries: DataFrame, bars: DataFrame, stop_bps: float, take_bps: float, hold_minutes: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, entry_id, exit_time, exit_reason, exit_price): the first bar after each entry whose close passes the stop, then the target, or that
    reaches the holding time; else the session's last bar. An entry without a later bar has no row."""
    found = _swept(entries, bars, keys, "entry_time", "entry_id", {"_price": F.col("entry_price").cast("double")}, ("close",), "exit_us long, exit_reason string, exit_price double", lambda: _Exits(stop_bps, take_bps, hold_minutes * 60_000_000))
    return found.select(*keys, "entry_id", F.timestamp_micros("exit_us").alias("exit_time"), "exit_reason", "exit_price")
