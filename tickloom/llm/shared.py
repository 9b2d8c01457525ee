"""Helpers that the operators share: columns by position, files in the shared folder, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine (as in tests) gets a
    folder of its own; any other raises, as executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Rows with whole texts go to Python this many at a time, which bounds a worker's memory; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that is run inside deletes its shuffle files when it ends, not when the driver's memory happens to be collected: for work that
    stores each step. The session's own setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go to a folder of their own in the shared one, which is deleted at the end: for work whose result is written by then."""
    _scratch.append(f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        deleted(spark, _scratch.pop())


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches, rows: int = 1000) -> Iterator:
    """Arrow batches in slices of some rows, so that only these are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy() -> None:
    """Give memory that is free back to the system: a Python worker waits with what its last task left it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def held(key=None, make=None):
    """What this Python worker keeps from task to task: one thing at a time, so the tables of one operator go when another's tasks come."""
    if key not in _held:
        _held.clear()
        tidy()
        if make is not None:
            _held[key] = make()
    return _held.get(key)


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, as `id` and `text`; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: unsigned 64-bit integers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space of more than one byte, as str.split() has it; the table has that of one byte.
WIDE_SPACE = dict.fromkeys([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], " ")
WIDE_CHARACTERS = [chr(x) for x in WIDE_SPACE]
SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, 2**bits of them."""
    out = [np.full(1 << bits, x, np.uint64) for x in (BASE, INVERSE)]
    for x in out:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return out[0], out[1]


def plain_bytes(text: str) -> bytes:
    """A text lower-cased, white space of several bytes made spaces, in UTF-8."""
    text = text.lower()
    if not text.isascii() and any(c in text for c in WIDE_CHARACTERS):
        text = text.translate(WIDE_SPACE)
    return text.encode("utf-8", "surrogatepass")


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte at which it starts) of each word of plain_bytes, and the bytes as an array: words are what str.split() gives.

    A word's hash is no polynomial: each byte draws a random number for its place in the word, so no two words collide by construction.
    """
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    low = space[1:-1]
    np.less_equal(data, 32, out=low)
    if not SPACE[data[low]].all():  # other control characters
        low[:] = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    return drawn_hashes(data, start, end), start, data


@lru_cache(maxsize=1)
def _drawn() -> np.ndarray:
    """A random number for each of 64 places in a word and each byte."""
    return np.random.default_rng(0x5EED).integers(0, 2**64, 64 * 256, np.uint64)


def drawn_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Hashes of spans of bytes, which rise and do not overlap: the sum of the numbers that the span's bytes draw (tabulation); spans of more
    than 64 bytes take a cryptographic hash of their bytes."""
    out, table, size = np.empty(len(start), np.uint64), _drawn(), end - start
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= 64)
    begin, size = start[short], size[short]
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, step)), len(short)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n, first = size[a:b], ends[a:b] - size[a:b] - (int(ends[a]) - int(size[a]))
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[place << 8 | data[np.repeat(begin[a:b], n) + place]])])
        out[short[a:b]] = mixed(sums[first + n] - sums[first] + n.astype(np.uint64))
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a equal those from b, for spans of `size` bytes each: eight bytes at a time, spans of more than 64 one by one."""
    out = np.ones(len(a), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    short = np.flatnonzero((a != b) & (size <= 64))
    for at in range(0, 64, 8):
        short = short[size[short] > at]
        if not len(short):
            break
        left = np.minimum(size[short] - at, 8).astype(np.uint64)
        differ = (eights[a[short] + at] ^ eights[b[short] + at]) << (np.uint64(64) - left * np.uint64(8))
        out[short] &= differ == 0
    for i in np.flatnonzero((a != b) & (size > 64)).tolist():
        out[i] = data[a[i] : a[i] + size[i]].tobytes() == data[b[i] : b[i] + size[i]].tobytes()
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Quick hashes of the spans of bytes, which rise: polynomials modulo 2**64, which can be made to collide. Only for uses that compare what
    hashes alike or lose nothing by a collision. Spans that start in `step` bytes are worked on at a time."""
    out = np.empty(len(start), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), step)), len(start)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low, high = int(start[a]), int(end[b - 1])
        power, inverse = _powers(max(20, (high - low + 1).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.multiply(data[low:high], power[: high - low], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        first, last = start[a:b] - low, end[a:b] - low
        out[a:b] = mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node of its component.

    Rounds of large-star and small-star (Kiveris et al., 2014). Each is two group-bys over the edges and is stored in the shared
    folder, so the edges never meet in one task or on the driver. Neighbours are reached by joining each edge with its centre's
    smallest neighbour, not by gathering a node's neighbours in one row: a hub with any number of edges is a join key that
    adaptive execution may split. Raises if the edges still change after max_rounds.
    """
    spark = edges.sparkSession

    def canonical(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every larger neighbour of a node goes to the node's minimum; small: every smaller one, and the node itself
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(canonical(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))), "edges")
    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = stored(canonical(star(canonical(star(now, True)), False)), "edges")
        if (new := state(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
