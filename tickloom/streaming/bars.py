"""Structured Streaming forms: tick bars, complete blocks, duplicates and conflicts, signals (SURVEY S)."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ticks from Parquet files: symbol, ts, price, event_id, session_date."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream's plain path may not be a single file
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id", F.to_date("ts").alias("session_date"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder (with its checkpoint beside it) and read the folder."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_until_silent(stream: DataFrame, path: str, silence_s: float, most_s: float = 60) -> DataFrame:
    """Run a stream of a processing-time clock over what is there now, then for silence_s more and until further batches are done, so
    timers that end in the silence have fired; most_s bounds the run. Such a stream has no last batch of its own."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    try:
        ends = time.monotonic() + most_s

        def passed(batch: int) -> int:
            """Wait until the batch is done; the last one that is."""
            done = -1
            while query.isActive and done < batch and time.monotonic() < ends:
                time.sleep(0.2)
                done = query.lastProgress["batchId"] if query.lastProgress else -1
            return done

        last = passed(0)  # takes all that is there
        time.sleep(silence_s)
        passed(last + 3)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Append the stream's rows to a Parquet folder, one of each key, but not those whose key is there already: a batch that is replayed, or
    events that another stream has delivered, add nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        there = spark.read.schema(batch.schema).parquet(path).select(*keys).distinct()
        batch.dropDuplicates(keys).join(there, keys, "left_anti").write.mode("append").parquet(path)

    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bars(ticks: DataFrame, minutes: int = 60, late: str = "2 minutes") -> DataFrame:
    """Bars by event time; a bar comes out when the watermark passes its end."""
    order = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("available_at"), "open", "high", "low", "close", "volume")


def complete_blocks(ticks: DataFrame, minutes: int, blocks: int, late: str = "2 minutes") -> DataFrame:
    """Windows of `blocks` slots of `minutes` that have a tick in every slot, once the watermark passes them."""
    slot = F.floor(F.unix_timestamp("ts") / (60 * minutes))
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes * blocks} minutes").alias("w")).agg(F.size(F.collect_set(slot)).alias("slots"), F.count("*").alias("volume"))
    return out.where(F.col("slots") == blocks).select("symbol", F.col("w.start").alias("bar_start"), "volume")


def deduplicated(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "2 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class BarState(StatefulProcessor):
    """Minute bars of a symbol: repeats are dropped, repeats with other content and late bars are reported, and a block comes out when it is complete.

    State: each slot of the open block with its close and volume, and the latest time. A bar more than `late_s` before the latest is late.
    """

    def __init__(self, slot_s: int, block: int, late_s: int):
        self.slot_s, self.block, self.late_s = slot_s, block, late_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", T.StructType([T.StructField("slot", T.LongType())]), T.StructType([T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType())]))
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        frame = pd.concat(list(rows)).sort_values(["t", "close", "volume"], kind="stable")
        for t, close, volume in frame[["t", "close", "volume"]].itertuples(index=False):
            latest = self.latest.get()[0] if self.latest.exists() else t
            slot = t // self.slot_s
            if t < latest - self.late_s:
                out.append((key[0], "late", t, close, volume))
                continue
            if self.slots.containsKey((slot,)):
                if tuple(self.slots.getValue((slot,))) != (close, volume):
                    out.append((key[0], "conflict", t, close, volume))
                continue
            self.slots.updateValue((slot,), (float(close), int(volume)))
            self.latest.update((max(latest, t),))
            first = slot - slot % self.block
            own = [(s,) for s in range(first, first + self.block)]
            if all(self.slots.containsKey(s) for s in own):
                values = [self.slots.getValue(s) for s in own]
                out.append((key[0], "block", first * self.slot_s, values[-1][0], sum(v[1] for v in values)))
        if self.latest.exists():  # slots that only late bars could still fill go
            least = self.latest.get()[0] - self.late_s - self.block * self.slot_s
            for s in [s[0] for s in self.slots.keys() if s[0] * self.slot_s < least]:
                self.slots.removeKey((s,))
        yield pd.DataFrame(out, columns=["symbol", "kind", "t", "close", "volume"])

    def close(self) -> None:
        pass


def stateful_blocks(bars_: DataFrame, slot_s: int, block: int, late_s: int) -> DataFrame:
    """Blocks, conflicts and late bars of a stream of bars (symbol, t in seconds, close, volume)."""
    schema = "symbol string, kind string, t long, close double, volume long"
    return bars_.groupBy("symbol").transformWithStateInPandas(statefulProcessor=BarState(slot_s, block, late_s), outputStructType=schema, outputMode="append", timeMode="none")


def feed_health(rows: DataFrame, gap_s: int, time: str = "ts", keys: tuple[str, ...] = ("symbol", "session_date")) -> DataFrame:
    """For each group the gaps longer than gap_s and the longest, in seconds (a batch over the log)."""
    from pyspark.sql import Window

    gap = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    return rows.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.coalesce(F.sum((F.col("gap") > gap_s).cast("long")), F.lit(0)).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))
