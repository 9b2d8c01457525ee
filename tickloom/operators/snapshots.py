"""Published snapshots that can be checked: data, and tables of what it holds; replay state that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("symbol", "session_date")


def manifest(bars: DataFrame) -> DataFrame:
    """(symbol, session_date, rows, first_start, last_start, volume, content): content is a sum of row digests over prices in millionths, so it
    doesn't depend on the order or the files of the rows."""
    millionths = [F.coalesce(F.round(F.col(c) * 1_000_000).cast("long").cast("string"), F.lit("-")) for c in ("open", "high", "low", "close")]
    digest = F.md5(F.concat_ws("|", F.unix_timestamp("bar_start").cast("string"), *millionths, F.coalesce(F.col("volume").cast("string"), F.lit("-"))))
    return bars.groupBy(*KEYS).agg(
        F.count("*").alias("rows"), F.min(F.unix_timestamp("bar_start")).alias("first_start"), F.max(F.unix_timestamp("bar_start")).alias("last_start"), F.sum("volume").alias("volume"),
        F.sum(F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")).alias("content"),
    )


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """(file, rows, bytes) of a folder of Parquet, files named from the folder on; a file without rows is not seen."""
    rows = spark.read.schema(schema).parquet(path).select("_metadata.file_path", "_metadata.file_size")
    name = F.regexp_extract("file_path", r"([^/]+=[^/]+/[^/]+|[^/]+)$", 1)
    return rows.groupBy(name.alias("file")).agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))


def publish(bars: DataFrame, path: str, quality: DataFrame) -> None:
    """Write bars by session, and beside them their manifest, their quality and the rows of each file, as found in what was written."""
    spark = bars.sparkSession
    bars.repartition("session_date").write.partitionBy("session_date").parquet(f"{path}/data")
    manifest(read(spark, path, bars.schema)).write.parquet(f"{path}/manifest")
    quality.write.parquet(f"{path}/quality")
    files(spark, f"{path}/data", bars.schema).write.parquet(f"{path}/files")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data")


def differing(published: DataFrame, found: DataFrame, part: str, *keys: str) -> DataFrame:
    """(part, key, field, published, found) for every field that differs, as text, with `present` for rows that only one side has."""
    fields = [c for c in published.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(name))
    both = side(published, "a").join(side(found, "b"), list(keys), "full")
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.alias("published"), b.alias("found"))
    alone = F.col("a").isNull() | F.col("b").isNull()
    seen = lambda c: F.col(c).isNotNull().cast("string")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), row(c, F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in fields]))
    rows = F.when(alone, F.array(row("present", seen("a"), seen("b")))).otherwise(changed)
    return both.select(F.lit(part).alias("part"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.explode(rows).alias("d")).select("part", "key", "d.*")


def check(spark: SparkSession, path: str, schema, quality) -> DataFrame:
    """What of a snapshot differs from what it published: its data's manifest, its quality (quality: a function of bars) and its files, each
    computed anew from the data. No rows: it is as it was published."""
    data = read(spark, path, schema)
    parts = [("manifest", manifest(data), KEYS), ("quality", quality(data), KEYS), ("files", files(spark, f"{path}/data", schema), ("file",))]
    found = [differing(spark.read.schema(df.schema).parquet(f"{path}/{name}"), df, name, *keys) for name, df, keys in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def replay_state(log: DataFrame, entity: str, time: str, tie: str, payload: str) -> DataFrame:
    """(entity, last, events): the last event of each entity, by time and tie, and how many there were. States merge."""
    return log.groupBy(F.col(entity).alias("entity")).agg(F.max(F.struct(F.col(time).alias("time"), F.col(tie).alias("tie"), F.col(payload).alias("payload"))).alias("last"), F.count("*").alias("events"))


def merged(*states: DataFrame) -> DataFrame:
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("entity").agg(F.max("last").alias("last"), F.sum("events").alias("events"))


def save_state(state: DataFrame, path: str, upto: str) -> None:
    """Store a replay state with the session up to which (inclusive) it has read the log."""
    state.withColumn("upto", F.lit(upto)).write.parquet(path)


def resumed(spark: SparkSession, path: str, log: DataFrame, session: str, **how: str) -> DataFrame:
    """The state after the whole log, from a stored state and the sessions after it: of a log that is partitioned by session, no
    earlier one is read. An empty stored state means the whole log."""
    stored = spark.read.parquet(path)
    upto = stored.agg(F.max("upto")).first()[0]
    later = log if upto is None else log.where(F.col(session) > F.lit(upto))
    return merged(stored.drop("upto"), replay_state(later, **how))


def state_faults(resumed_state: DataFrame, clean: DataFrame) -> DataFrame:
    """(entity, field, published, found): where a resumed state differs from a clean replay, so a stored state that was forged or is stale shows."""
    flat = lambda df: df.select("entity", F.col("last.time").alias("time"), F.col("last.payload").alias("payload"), "events")
    return differing(flat(resumed_state), flat(clean), "state", "entity").select(F.col("key").alias("entity"), "field", "published", "found")
