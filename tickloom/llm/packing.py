"""Packing documents into windows of a fixed number of tokens by best-fit decreasing.

Documents are encoded once to cut them into pieces: full windows from the start, and a remainder. Remainders are dealt by a hash of
document id, piece start and checksum into groups of about `group_rows` pieces; within a group they are placed in order of falling
length, each into the open window whose remaining capacity is the least that holds it, found in a segment tree over capacities. Only lengths are dealt,
never texts or ids. Padding comes from the last open windows of a group, so it falls with the group's size, not the corpus's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretoken import cutter
from tickloom.llm.shared import keyed_texts, slices, tidy

#: Entries of each table of pre-tokens that a Python worker keeps.
TABLE = 60_000
PIECE_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: each node counts the open windows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and give (room, window) of the tightest window with room for length, or None."""
        count, node = self.count, length + self.size
        while not count[node]:
            while node & 1:  # a right child: nothing larger under this parent
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last node of its level
                return None
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, in the order given; lengths must fall and lie in 1..capacity."""
    tree, opened = CapacityTree(capacity), 0
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        room, w = tree.take(n) or (capacity, opened)
        opened += w == opened
        window[i], offset[i] = w, capacity - room
        if room > n:
            tree.put(room - n, w)
    return window, offset


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (PIECE_SCHEMA) for each piece of capacity ids at most of every document, which ends with end_id."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        table, end = cutter(tokenizer_path, TABLE), end_id.to_bytes(2, "little")
        for batch in slices(batches):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), table.encode_many(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data + end, "<u2").astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append((key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], ["id", "start", "length", "ids_crc32", "doc_tokens"])
        table.clear()  # a waiting worker keeps no tables
        tidy()

    return keyed_texts(docs, id_col, text_col).mapInArrow(cut, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, n_groups: int, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset. Sequence ids are unique, not consecutive: the group and the window within it.

    Groups are hashes of the piece, so no key can fill one; ties in length are ordered by document, start and checksum.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        window, offset = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["grp"].to_numpy() * (1 << 32) + window, offset=offset).drop(columns="grp")

    spread = F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens"), F.lit(n_groups))
    return pieces.withColumn("grp", spread).groupBy("grp").applyInPandas(pack, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, group_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their sequence_id and offset.

    A null or empty text is one piece that holds the end id alone; a null id stays null; equal rows are packed one by one; other
    columns are not read; an empty table gives no rows. group_rows is the mean number of documents to a packing group.
    """
    n_groups = -(-docs.select(F.lit(1)).count() // group_rows) or 1
    pieces = cut_documents(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    return pack_pieces(pieces, n_groups, capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = 2, pad_id: int = 0, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 16-bit, padded), n_ids (before padding). Document ids must be unique.

    A sequence is padded to capacity; one that ends at a power of two is left as it is.
    """
    end = end_id.to_bytes(2, "little")

    def encode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = cutter(tokenizer_path, TABLE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([table.encode(x.as_py()) + end for x in batch.column(1)], pa.binary())], ["id", "ids"])

    encoded = keyed_texts(docs, id_col, text_col).mapInArrow(encode, "id long, ids binary")
    spans = packed.select(F.col(id_col).alias("id"), "start", "length", "sequence_id", "offset")
    cut = F.substring("ids", (2 * F.col("start") + 1).cast("int"), (2 * F.col("length")).cast("int"))
    pieces = spans.join(encoded, spans["id"].eqNullSafe(encoded["id"])).select("sequence_id", "offset", "length", cut.alias("piece"))
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("pieces"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("pieces", F.lit(b""), lambda out, x: F.concat(out, x["piece"]))
    bare = F.bit_count("n_ids") == 1
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(2, "little").hex()), F.when(bare, 0).otherwise((capacity - F.col("n_ids")).cast("int"))))
    return rows.select("sequence_id", F.concat(joined, pad).alias("ids"), "n_ids")
