"""Report tables (SURVEY R) and file fingerprints (A3, A7, J20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and SHA-256 of each file, worked out where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def require_files(files: DataFrame, names: list[str], max_rows: int = 128, max_bytes: int = 8 << 30) -> DataFrame:
    """The named files; an error if one is absent, or if they are more or larger than allowed."""
    own = files.where(F.col("file").isin(names))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n < len(set(names)):
        raise ValueError("a named file is absent")
    if n > max_rows or size > max_bytes:
        raise ValueError("more files or bytes than allowed")
    return own


def slippage(orders: DataFrame) -> DataFrame:
    """Fill against limit in basis points, signed so that more is worse: side, limit_price, fill_price."""
    move = (F.col("fill_price") - F.col("limit_price")) / F.nullif(F.col("limit_price"), F.lit(0.0)) * 10_000
    return orders.where("fill_price IS NOT NULL").withColumn("slippage_bps", F.when(F.col("side") == "buy", move).otherwise(-move))


def funnel(rows: DataFrame, phases: list[tuple[str, str]]) -> DataFrame:
    """Count of rows that reach each phase, in order: a phase holds if its condition and all earlier ones do."""
    reached, out = F.lit(True), []
    for i, (name, condition) in enumerate(phases, 1):
        reached = reached & F.coalesce(F.expr(condition), F.lit(False))
        out.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("phase"), reached.cast("long").alias("n")))
    return rows.select(F.explode(F.array(*out)).alias("p")).groupBy("p.ordinal", "p.phase").agg(F.sum("p.n").alias("rows"))


def size_counts(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several tables by key, one column of table names."""
    parts = [df.groupBy(key).agg(F.count("*").alias("rows")).select(F.lit(name).alias("bar_size"), key, "rows") for name, df in sorted(frames.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
