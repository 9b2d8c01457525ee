"""Token ids as wavelet matrices, one for each shard of documents.

A shard is one self-contained, compressed binary: a header, the document ids and lengths, and for each bit of the token ids a
bit-plane, compressed in pieces, with the rank directory over it. From one shard one can read any token (access), count a token in a range
(rank), find its occurrences (select) and restore all ids; look-ups inflate only the directories and the pieces of planes that they touch.
Shards are written and read by Spark as rows of a Parquet folder, so writing is committed task by task and works on any store that Spark can
write to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.pretoken import cutter
from tickloom.llm.shared import keyed_texts, slices

MAGIC = b"WVM2"
#: Bits of a plane between two entries of its rank directory, and bytes of its pieces.
BLOCK, PIECE = 512, 1 << 14
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, shard binary"


class Plane:
    """A bit-plane: its bytes in pieces of PIECE, each inflated when it is first read, and the ones before each block of BLOCK bits."""

    def __init__(self, pieces: list, squeezed: bool, ranks):
        self.pieces, self.squeezed, self._ranks = pieces, [squeezed] * len(pieces), ranks

    @classmethod
    def of_bits(cls, bit: np.ndarray) -> Plane:
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return cls([padded[at : at + PIECE] for at in range(0, len(padded), PIECE)], False, np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]))

    @property
    def ranks(self) -> np.ndarray:
        if not isinstance(self._ranks, np.ndarray):
            self._ranks = np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.decompress(self._ranks), "<u2"), dtype=np.int64)])
        return self._ranks

    def piece(self, i: int) -> np.ndarray:
        if self.squeezed[i]:
            self.pieces[i], self.squeezed[i] = np.frombuffer(zstandard.decompress(self.pieces[i]), np.uint8), False
        return self.pieces[i]

    def blocks(self, block: np.ndarray) -> np.ndarray:
        """The bits of the blocks, a row each."""
        out, size = np.empty((len(block), BLOCK // 8), np.uint8), PIECE * 8 // BLOCK
        for i in np.unique(block // size).tolist():
            rows = np.flatnonzero(block // size == i)
            out[rows] = self.piece(i).reshape(-1, BLOCK // 8)[block[rows] % size]
        return np.unpackbits(out, axis=1, bitorder="little")

    def all_bits(self, n: int) -> np.ndarray:
        bytes_ = np.concatenate([self.piece(i) for i in range(len(self.pieces))]) if self.pieces else np.zeros(0, np.uint8)
        return np.unpackbits(bytes_, count=n, bitorder="little").view(bool)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at, ones before) each position; at the end of the plane the bit is 0."""
        bit, ones = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            block = np.minimum(some // BLOCK, max(len(self.ranks) - 2, 0))
            inside = some - block * BLOCK
            if len(self.ranks) > 1:
                bits = self.blocks(block)
                ones[i : i + 4096] = self.ranks[block] + (bits * (np.arange(BLOCK) < inside[:, None])).sum(axis=1)
                bit[i : i + 4096] = np.where(inside < BLOCK, bits[np.arange(len(some)), np.minimum(inside, BLOCK - 1)], 0)
        return bit, ones

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Where the k-th bits (from 0) of that value stand: their blocks by binary search in the directory."""
        before = self.ranks if value else np.arange(len(self.ranks)) * BLOCK - self.ranks
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 4096):
            some = k[i : i + 4096]
            block = np.searchsorted(before, some, side="right") - 1
            count = np.cumsum(self.blocks(block) == value, axis=1)
            out[i : i + 4096] = block * BLOCK + (count <= (some - before[block])[:, None]).sum(axis=1)
        return out


class WaveletMatrix:
    """A sequence of unsigned integers below 2**bits as bit-planes, the highest bit first; each plane orders the next one stably by its bit."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.bits = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << b)) != 0
            planes.append(Plane.of_bits(bit))
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            ids = np.concatenate([ids.take(low), ids.take(np.flatnonzero(bit))])
        return cls(len(ids), planes, zeros)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            bit, ones = plane.look(at)
            out = out << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def span(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences before position end lie below the last plane."""
        low, high = 0, end
        for level, plane in enumerate(self.planes):
            one_low, one_high = plane.look(np.array([low, high]))[1].tolist()
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + one_low, self.zeros[level] + one_high
            else:
                low, high = low - one_low, high - one_high
        return low, high

    def rank(self, value: int, end: int) -> int:
        """Occurrences of the value before position end."""
        if not 0 <= value < 1 << self.bits or self.n == 0:
            return 0
        low, high = self.span(value, min(max(end, 0), self.n))
        return high - low

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(value, self.n if end is None else end) - self.rank(value, start)

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places below the last plane that hold the value."""
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of the value, in order: select of each of its ranks."""
        if not 0 <= value < 1 << self.bits or self.n == 0:
            return np.zeros(0, np.int64)
        low, high = self.span(value, self.n)
        return self._up(value, np.arange(low, high))

    def select(self, value: int, k: int) -> int:
        """The position of the value's k-th occurrence, from 0; -1 if there are fewer."""
        if not 0 <= value < 1 << self.bits or self.n == 0 or k < 0:
            return -1
        low, high = self.span(value, self.n)
        return int(self._up(value, np.array([low + k]))[0]) if low + k < high else -1

    def values(self) -> np.ndarray:
        """The whole sequence: each plane's bits put before the lower bits, whose order the plane gives."""
        lower = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit, zeros = self.planes[level].all_bits(self.n), self.zeros[level]
            here = np.empty_like(lower)
            lower[zeros:] |= lower.dtype.type(1 << (self.bits - 1 - level))
            here[np.flatnonzero(~bit)] = lower[:zeros]
            here[np.flatnonzero(bit)] = lower[zeros:]
            lower = here
        return lower


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A shard's bytes. A null document id is kept as such."""
    matrix = WaveletMatrix.build(ids, bits)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    for plane in matrix.planes:
        parts += [np.diff(plane.ranks).astype("<u2").tobytes(), *(x.tobytes() for x in plane.pieces)]
    squeezed = [zstandard.compress(x, 1) for x in parts]
    head = struct.pack("<4sBQQ", MAGIC, bits, len(doc_ids), len(ids)) + np.array(matrix.zeros, "<u8").tobytes() + np.array([len(x) for x in squeezed], "<u8").tobytes()
    return head + b"".join(squeezed)


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(document ids, their lengths, the wavelet matrix) of a shard. The planes stay compressed until they are read."""
    magic, bits, n_docs, n = struct.unpack_from("<4sBQQ", data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at, each = struct.calcsize("<4sBQQ"), 1 + -(-(-(-n // BLOCK) * BLOCK // 8) // PIECE)  # parts of a plane: its directory and its pieces
    zeros = np.frombuffer(data, "<u8", bits, at).astype(int).tolist()
    sizes = np.frombuffer(data, "<u8", 3 + each * bits, at + 8 * bits)
    ends = at + 8 * bits + 8 * len(sizes) + np.cumsum(sizes).astype(int)
    view = memoryview(data)
    parts = [view[int(e) - int(s) : int(e)] for e, s in zip(ends, sizes, strict=True)]
    known, keys, lengths = (zstandard.decompress(x) for x in parts[:3])
    doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(keys, "<i8"), known, strict=True)]
    planes = [Plane(parts[i + 1 : i + each], True, parts[i]) for i in range(3, len(parts), each)]
    return doc_ids, np.frombuffer(lengths, "<u4"), WaveletMatrix(n, planes, zeros)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id to each document, and write the shards in ascending order of the document id.

    Rows are dealt by ranges of the id, then sorted, so (part, seq) orders the shards. A shard closes with the document that fills
    it to shard_tokens, so it holds that many ids and one document at most. A null or empty text is the end id alone; a null id
    comes first; equal ids keep a row each, ordered by text; an empty table writes an empty folder.
    """
    bits = 16

    def encode(batches) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys, lengths, blobs, held = [], [], [], 0
        end = end_id.to_bytes(2, "little")

        def shard():
            data = pack_shard(keys, lengths, np.frombuffer(b"".join(blobs), "<u2"), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in slices(batches):
            table = cutter(tokenizer_path)
            for key, data in zip(batch.column(0).to_pylist(), table.encode_many(batch.column(1).to_pylist()), strict=True):
                data += end
                keys.append(key)
                lengths.append(len(data) // 2)
                blobs.append(data)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield shard()
                    keys, lengths, blobs, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    rows = keyed_texts(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SHARD_SCHEMA."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before each one. Sums run within a part, then over one row for each part."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part").select("part", "seq", (F.col("own") + F.col("base")).alias("shard_start"))


def documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the shards: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys, lengths, matrix = unpack_shard(data.as_py())
                raw = memoryview(matrix.values().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["part", "seq", "id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "shard").mapInArrow(decode, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token_id: int, id_col: str = "doc_id") -> DataFrame:
    """(id, position in the document) of every occurrence of a token, from the shards' select support."""

    def find(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                keys, lengths, matrix = unpack_shard(data.as_py())
                at = matrix.occurrences(token_id)
                ends = np.cumsum(lengths, dtype=np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in doc], pa.int64()), pa.array(at - (ends - lengths)[doc], pa.int64())], ["id", "position"])

    return shards.select("shard").mapInArrow(find, "id long, position long").withColumnRenamed("id", id_col)
