"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are laid out by the population counts of their four 16-bit lanes. Lane counts that differ by more than the
radius in sum mean more differing bits than the radius, so only tiles of near lane counts are compared: numpy exclusive-or and
bit counts over the two tiles. A tile holds about `tile` fingerprints; a pair of tiles yields a forest of links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import components, held, keyed_texts, stored, tidy

SEED = 42
LANES = 4
#: Shingles hashed at a time, which bounds what one long text needs.
STEP = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included, each hashed with XXH64: a bit is set if it is set in over half of them."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        some = words[at : at + STEP + size - 1]
        joined = map(b" ".join, zip(*(some[k:] for k in range(size)), strict=False))
        hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in joined), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash): the fingerprint of every whole text as a signed long with the same bits, and a hash of the text. A text without words (or null) has fingerprint 0."""

    def compute(batches) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["id", "fp", "text_hash"])
        tidy()

    rows = keyed_texts(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(compute, "id long, fp long, text_hash long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles (or of one, given twice) that join the same components as all pairs within the radius."""
    rows, cols = [], []
    for at in range(0, len(a), 256):
        r, c = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        rows.append(r + at)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    keep = a[r] != b[c]
    r, c = r[keep], c[keep]
    if len(r) <= len(a) + len(b):
        return a[r], b[c]
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    r, c = place[: len(a)][r], place[len(a) :][c]
    label = np.arange(len(values))
    while True:  # smallest label over the links, then over labels, until nothing moves
        new = label.copy()
        np.minimum.at(new, r, label[c])
        np.minimum.at(new, c, label[r])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(prints: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(a, b): links that join the same components of the distinct values in `prints.fp` as all pairs within the radius."""
    lane = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(LANES)]
    cell = sum((x * 32**k for k, x in enumerate(lane)), F.lit(0)).cast("int")
    rows = prints.select("fp").distinct().select("fp", cell.alias("cell"))
    # 17**4 cells at most, whatever the input
    subs = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("subs"))
    tiles = rows.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    tiles = stored(tiles.groupBy("cell", "sub").agg(F.collect_list("fp").alias("fps")), "tiles")
    moves = [sum(d * 32**k for k, d in enumerate(m)) for m in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, m)) <= radius]
    # each tile goes to every pair it is part of: the tiles of the near cells, looked up in the table of cells
    sizes = tiles.groupBy("cell").agg((F.max("sub") + 1).alias("subs")).select(F.col("cell").alias("to"), "subs")
    sent = tiles.select("*", F.explode(F.array(*[F.col("cell") + m for m in moves])).alias("to")).join(F.broadcast(sizes), "to")
    sent = sent.select("cell", "sub", "to", "fps", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("to_sub"))
    here, there = F.struct(F.col("cell").alias("c"), F.col("sub").alias("s")), F.struct(F.col("to").alias("c"), F.col("to_sub").alias("s"))
    sent = sent.select(F.least(here, there).alias("low"), F.greatest(here, there).alias("high"), (here <= there).alias("first"), "fps")
    met = sent.groupBy("low", "high").agg(F.max(F.when(F.col("first"), F.col("fps"))).alias("x"), F.max(F.when(~F.col("first"), F.col("fps"))).alias("y"))

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a = x.values.to_numpy().view(np.uint64)
                b = a if y.values is None else y.values.to_numpy().view(np.uint64)
                p, q = forest(a, b, radius)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], ["a", "b"])

    return met.where("x is not null").select("x", "y").mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, size: int = 3, radius: int = 2, tile: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, root): one row for each document, with the smallest fingerprint reachable over links of its own. The hash tells
    unlike texts of one id apart."""
    prints = stored(fingerprints(docs, size, id_col, text_col), "prints")
    root = components(links(prints, radius, tile))
    return prints.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("id", "text_hash", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, tile: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links).

    Fingerprints that differ in at most `radius` bits are linked. Texts without words, null ones among them, have fingerprint zero and
    are linked like any other; a null id stays null and never is a component's id unless all its ids are; equal rows each give a row;
    other columns are not read; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, size, id_col, text_col), "prints")
    own = prints.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(prints, radius, tile))
    class_of = own.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = class_of.join(least, "root").select("fp", "component_id")
    return prints.join(class_of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
