"""Near-duplicate passages across documents by compact windows.

A document is a sequence of five-word shingles, each hashed under several functions. For one function, the Cartesian tree of the
hashes gives each shingle the widest window in which it is the minimum: all subsequences there that hold it share its
min-hash. Only shingles that are the minimum of some window of the least passage length have windows that count. Windows of the
functions of a band are joined where their intervals overlap, so a band's signature is a tuple of min-hashes. Documents that share a signature
are compared shingle by shingle over the windows concerned, each with the first document of the signature's group. Windows that
don't match there are grouped again by their rarest shingles, with all members of their groups, until each is matched or has met every member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import hashed_words, keyed_texts, mixed, plain_bytes, shuffles_freed, stored, tidy

SHINGLE = 5
#: The hash functions of each band; a passage of the least length at similarity 0.8 agrees on a band with probability 0.64.
BANDS = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12))
#: Counters of the rarity of shingles; their number does not depend on the input.
BUCKETS = 1 << 18
#: Characters that are worked on at a time; a longer text is worked on alone.
STEP = 400_000
#: Windows that are packed at a time.
HELD = 500_000
#: Bits of a signature by which windows are dealt, and bits that are kept besides.
DEALT, LOW = 11, 40
#: Bytes of packed windows that are opened at a time.
PART = 12_000_000
GROUPS = "sig long, id long, other long, first int, last int, other_first int, other_last int"


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts in a row, and the number of shingles of each; none of a text of fewer words."""
    plain = [plain_bytes(t) for t in texts]
    w, start, _ = hashed_words(b"\n".join(plain))
    sizes = np.array([len(x) + 1 for x in plain], np.int64)
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    inside = text[:n] == text[SHINGLE - 1 :]
    return out[inside], np.bincount(text[:n][inside], minlength=len(texts))


def shingled(texts: pa.Array) -> Iterator[np.ndarray]:
    """shingle_hashes of each text, many hashed at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= STEP or i == len(texts) - 1:
            h, sizes = shingle_hashes(held)
            yield from np.split(h, np.cumsum(sizes)[:-1])
            held, size = [], 0


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` entries, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def nearest_smaller(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each entry the last one before it that is smaller and no earlier than entry low of it, else low - 1. What lies between an entry and
    where it points is larger, so an entry may jump to where a larger one points."""
    to = np.arange(len(values)) - 1
    todo = np.flatnonzero(to >= low)
    while len(todo := todo[values[to[todo]] > values[todo]]):
        to[todo] = np.maximum(to[to[todo]], low[todo] - 1)
        todo = todo[to[todo] >= low[todo]]
    return to


def tree_spans(values: np.ndarray, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate, the span between the nearest smaller candidates of its document: its subtree in the Cartesian tree."""
    n, edge = len(values), np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sizes = np.diff(np.append(edge, n))
    low, high = np.repeat(edge, sizes), np.repeat(edge + sizes - 1, sizes)
    both = nearest_smaller(np.concatenate([values, values[::-1]]), np.concatenate([low, 2 * n - 1 - high[::-1]]))
    left, right = both[:n], 2 * n - 1 - both[n:][::-1]
    return np.where(left < low, begin, at[left] + 1), np.where(right > high, end, at[np.minimum(right, n - 1)] - 1)


def joint_windows(h: np.ndarray, sizes: np.ndarray, least: int, bands: tuple = BANDS) -> tuple[np.ndarray, ...]:
    """(document number, signature, first, last shingle) of the windows of every band, for documents whose shingle hashes are in a row."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    doc, starts = np.repeat(np.arange(len(sizes)), sizes), ends - sizes
    valid = np.flatnonzero(doc[: len(h) - least + 1] == doc[least - 1 :])
    mask = np.uint64((1 << max(len(h) - 1, 1).bit_length()) - 1)
    out = []
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    minima = []
    for f in (f for functions in bands for f in functions):
        packed = (mixed(h ^ mixed(np.full(1, f, np.uint64))) & ~mask) | np.arange(len(h), dtype=np.uint64)
        least_at = (sliding_minimum(packed, least)[valid] & mask).astype(np.int64)
        new = np.append(True, least_at[1:] != least_at[:-1])  # the place of the minimum never goes back
        minima.append((new, least_at[new], packed[least_at[new]]))
    own = np.concatenate([x for _, x, _ in minima])
    d, at = doc[own], np.cumsum([len(x) for _, x, _ in minima])
    trees = tree_spans(np.concatenate([x for _, _, x in minima]), own, d + len(sizes) * np.repeat(np.arange(len(minima)), np.diff(at, prepend=0)), starts[d], ends[d] - 1)
    trees = list(zip(*(np.split(x, at[:-1]) for x in trees), strict=True))
    for band, functions in enumerate(bands):
        at = sum(map(len, bands[:band]))
        (moved, winners, _), spans = zip(*minima[at : at + len(functions)], strict=True), trees[at : at + len(functions)]
        new = np.logical_or.reduce(moved)
        place = [np.cumsum(m[new]) - 1 for m in moved]
        first, last = np.max([left[p] for (left, _), p in zip(spans, place, strict=True)], axis=0), np.min([right[p] for (_, right), p in zip(spans, place, strict=True)], axis=0)
        key = np.full(len(first), band, np.uint64)
        for w, p in zip(winners, place, strict=True):
            key = mixed(key * np.uint64(3) + h[w][p])
        d = doc[winners[0][place[0]]]
        out.append((d, key, first - starts[d], last - starts[d]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """The buckets that occur, rising, and for each a binary of its rows: a row holds each column's low bytes, as many as the largest entry needs.
    The other arrays repeat those widths."""
    order = np.lexsort((columns[0], bucket))
    widths = [max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns]
    rows = np.concatenate([np.ascontiguousarray(c[order], "<u8").view(np.uint8).reshape(-1, 8)[:, :w] for c, w in zip(columns, widths, strict=True)], axis=1)
    used, begin = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(begin, len(rows)) * rows.shape[1], pa.int32())
    data = pa.BinaryArray.from_buffers(pa.binary(), len(used), [None, offsets.buffers()[1], pa.py_buffer(rows.tobytes())])
    return used, [data, *(pa.array(np.full(len(used), w, np.int32)) for w in widths)]


def unpacked(data: pa.Array, widths: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all rows in the binaries of data, which were packed with these widths, and the number of rows in each binary."""
    sizes = np.array([len(x) for x in data.to_pylist()], np.int64) // sum(widths)
    rows, out, at = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, sum(widths)), [], 0
    for w in widths:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :w] = rows[:, at : at + w]
        out.append(wide.view("<u8").ravel())
        at += w
    return out, sizes


def windows(docs: DataFrame, least: int, bands: tuple = BANDS) -> DataFrame:
    """Every document's joint windows, packed by the leading bits of their signature: bucket, base (an id) and rows of signature (LOW bits more), id
    less base, first shingle, length. Signatures keep LOW and the bucket's bits; those that become equal cost a comparison, no result."""

    def send(held: list) -> pa.RecordBatch:
        ids, sig, first, size = (np.concatenate(x) for x in zip(*held, strict=True))
        base = ids.min()
        used, columns = packed(sig >> np.uint64(64 - DEALT), [sig << np.uint64(DEALT) >> np.uint64(64 - LOW), ids.view(np.uint64) - base.view(np.uint64), first.view(np.uint64), size.view(np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), base)), *columns], ["bucket", "base", "data", "w0", "w1", "w2", "w3"])

    def chunks(batches) -> Iterator[tuple[list, list]]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= STEP:
                    yield keys, texts
                    keys, texts, size = [], [], 0
            if keys:
                yield keys, texts

    def read(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys, texts in chunks(batches):
            d, sig, first, last = joint_windows(*shingle_hashes(texts), least, bands)
            if len(d):
                held.append((np.array(keys, np.int64)[d], sig, first, last - first))
                n += len(d)
            if n >= HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return docs.mapInArrow(read, "bucket int, base long, data binary, w0 int, w1 int, w2 int, w3 int")


def opened(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(signature, id, span) of the windows in packed rows; span holds first and last shingle (first * 2**32 + last)."""
    out = []
    for batch in batches:
        widths = np.stack([batch.column(i).to_numpy() for i in range(3, 7)], axis=1)
        for w in np.unique(widths, axis=0):
            some = batch.filter(pa.array((widths == w).all(axis=1)))
            (low, ids, first, size), n = unpacked(some.column(2), w.tolist())
            bucket, base = (np.repeat(some.column(i).to_numpy().astype(np.int64), n) for i in (0, 1))
            out.append((bucket << LOW | low.view(np.int64), (ids + base.view(np.uint64)).view(np.int64), (first << np.uint64(32) | first + size).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated(sig: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows whose signature occurs twice or more, ordered by it."""
    order = np.argsort(sig)
    sig = sig[order]
    same = np.append(False, np.append(sig[1:] == sig[:-1], False))
    keep = np.flatnonzero(same[1:] | same[:-1]) if len(sig) else order
    return sig[keep], *(c[order[keep]] for c in columns)


def firsts(sig: np.ndarray, id_: np.ndarray, span: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, first id, its first span, last id) of each signature."""
    order = np.lexsort((span, id_, sig))
    sig, id_, span, last = sig[order], id_[order], span[order], last[order]
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
    if not len(begin):
        return sig, id_, span, last
    return sig[begin], id_[begin], span[begin], np.maximum.reduceat(last, begin)


def group_rows(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GROUPS of the windows in packed rows of whole buckets, read twice in parts: for the first document of each signature, and for the members."""
    parts, n = [[]], 0
    for batch in batches:
        size = batch.column(2).nbytes
        if parts[-1] and n + size > PART:
            parts.append([])
            n = 0
        parts[-1].append(batch)
        n += size
    table = None
    for part in parts:
        sig, id_, span = now = opened(part) if len(parts) > 1 else repeated(*opened(part))
        new = firsts(*now, id_)
        table = new if table is None else firsts(*(np.concatenate(x) for x in zip(table, new, strict=True)))
    lead, other, other_span, last = (x[table[1] < table[3]] for x in table)
    for part in parts if len(lead) else []:
        if len(parts) > 1:
            sig, id_, span = opened(part)
        at = np.minimum(np.searchsorted(lead, sig), len(lead) - 1)
        hit = np.flatnonzero(lead[at] == sig)
        hit = hit[np.lexsort((span[hit], id_[hit], sig[hit]))]
        for i in range(0, len(hit), 1 << 17):
            own = hit[i : i + (1 << 17)]
            to = at[own]
            ends = [x for s in (span[own], other_span[to]) for x in (s >> 32, s & 0xFFFFFFFF)]
            columns = [sig[own], id_[own], other[to], *(x.astype(np.int32) for x in ends)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "id", "other", "first", "last", "other_first", "other_last"])


def groups(sent: DataFrame) -> DataFrame:
    """GROUPS: every window (sig, id, first, last) whose signature two documents or more share, beside the first of these (other, other_first, other_last)."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(2).nbytes
            if size < PART:
                continue
            table = pa.Table.from_batches(held).to_batches()
            newest = int(batch.column(0)[-1].as_py())  # this bucket may go on
            whole = [b for b in (x.filter(pa.array(x.column(0).to_numpy() != newest)) for x in table) if b.num_rows]
            if whole:
                yield from group_rows(whole)
                held = [b for b in (x.filter(pa.array(x.column(0).to_numpy() == newest)) for x in table) if b.num_rows]
                size = sum(b.column(2).nbytes for b in held)
        if held := [b for b in held if b.num_rows]:
            yield from group_rows(held)
        tidy()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(read, GROUPS)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Spans as intervals of shingles, overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s >> 32, s & 0xFFFFFFFF) for s in spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def merged_rows(spans: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merged for many rows, whose spans are in a row, `sizes` of each: the intervals as spans, and their number in each row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((spans, row))
    row, first, last = row[order], spans[order] >> 32, spans[order] & 0xFFFFFFFF
    far = np.maximum.accumulate(row << 32 | last)  # the farthest so far: a later row is beyond all of one before
    new = np.append(True, (row[1:] << 32 | first[1:]) > far[:-1] + 1) | np.append(True, row[1:] != row[:-1])
    begin = np.flatnonzero(new[: len(row)])
    end = np.append(begin[1:], len(row))[: len(begin)] - 1
    return first[begin] << 32 | far[end] & 0xFFFFFFFF, np.bincount(row[begin], minlength=len(sizes))


def positions(spans: list[tuple[int, int]]) -> np.ndarray:
    """All shingles of merged spans, in order."""
    return np.concatenate([np.arange(a, b + 1) for a, b in spans])


def places(spans: np.ndarray) -> np.ndarray:
    """positions of intervals that are spans."""
    if len(spans) == 1:
        return np.arange(int(spans[0]) >> 32, (int(spans[0]) & 0xFFFFFFFF) + 1)
    first, last = spans >> 32, spans & 0xFFFFFFFF
    size = last - first + 1
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def codes(h: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each hash (32 bits), the same for equal ones, and how many there are."""
    key = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    high, out = key >> np.uint64(32), np.empty(len(h), np.int32)
    number = np.cumsum(np.append(False, high[1:] != high[:-1])[: len(h)], dtype=np.int32)
    out[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] = number
    return out, int(number[-1]) + 1 if len(h) else 0


class Marks:
    """Sets of codes below n: a set is the entries that hold its mark, so that a new one needs no clearing."""

    def __init__(self, n: int) -> None:
        self.of, self.place, self.now = np.zeros(n, np.int32), np.zeros(n, np.int32), 0

    def put(self, x: np.ndarray) -> int:
        self.now += 1
        if self.now == 2**31 - 1:
            self.now = 1
            self.of[:] = 0
        self.of[x] = self.now
        return self.now

    def distinct(self, x: np.ndarray) -> int:
        """The number of distinct codes in x: those entries that are a code's last."""
        order = np.arange(len(x), dtype=np.int32)
        self.place[x] = order
        return int(np.count_nonzero(self.place[x] == order))


def compare(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, least: int, tenths: int, marks: Marks) -> list[tuple[int, int, int, int, float]]:
    """Passages (first and last shingle in x, in y, similarity) of `least` shingles or more in both whose shingle sets have Jaccard
    similarity tenths/10 or more. x and y are codes of shingles.

    Sets of that similarity share 2t/(1+t) of their mean size, so a passage of x holds a stretch of `least` shingles of which that share is in y.
    Such stretches are joined where they overlap and trimmed to shared shingles; one that fails as a whole is cut at its widest gap.
    """
    if len(x) < least or len(y) < least:
        return []
    mark, gap, out = marks.put(y), 2 * SHINGLE, []
    shared = marks.of[x] == mark
    sums = np.zeros(len(x) + 1, np.int32)
    np.cumsum(shared, out=sums[1:])
    dense = np.flatnonzero((sums[least:] - sums[:-least] >= -(-2 * tenths * least // (10 + tenths))) & (at_x[least - 1 :] - at_x[: len(x) - least + 1] == least - 1))
    if not len(dense):
        return []
    cover = np.zeros(len(x) + 1, np.int64)
    cover[dense] += 1
    cover[dense + least] -= 1
    hit = np.flatnonzero((np.cumsum(cover)[:-1] > 0) & shared)
    where = at_x[hit]
    cuts = [0, *(np.flatnonzero(where[1:] - where[:-1] > least) + 1).tolist(), len(hit)]
    todo = [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]  # runs of hit
    while todo:
        i, j = todo.pop()
        a, b = int(where[i]), int(where[j - 1])
        if b - a + 1 < least:
            continue
        own, found = x[hit[i] : hit[j - 1] + 1], []
        mark, n_x = marks.put(own), marks.distinct(own)
        inside = marks.of[y] == mark
        there = np.flatnonzero(inside)
        place = at_y[there]
        edges = np.flatnonzero(place[1:] - place[:-1] > gap) + 1
        begin, end = np.append(0, edges), np.append(edges, len(there)) - 1
        for p in np.flatnonzero(place[end] - place[begin] + 1 >= least).tolist() if len(there) else []:
            u, v = int(there[begin[p]]), int(there[end[p]])
            other = y[u : v + 1]
            n_y, both = marks.distinct(other), marks.distinct(other[inside[u : v + 1]])
            if 10 * both >= tenths * (n_x + n_y - both):
                found.append((a, b, int(at_y[u]), int(at_y[v]), both / (n_x + n_y - both)))
        out += found
        apart = where[i + 1 : j] - where[i : j - 1]
        if not found and len(apart) and apart.max() > 1:
            cut = i + int(apart.argmax()) + 1
            todo += [(i, cut), (cut, j)]
    return out


#: Slots of keys by which rows that a join has no use for are left out before they are dealt; their number does not depend on the input.
SLOTS = 1 << 20


def among(rows: DataFrame, keys: DataFrame, name: str, key: str) -> DataFrame:
    """Those of rows whose column `name` shares a slot with `key` of one of keys: all that a join needs, and few more as long as there are many slots."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    return rows.join(F.broadcast(keys.select(slot(key).alias("slot")).distinct()), slot(name) == F.col("slot"), "left_semi")


PASSAGES = "id long, start long, end long, other_id long, other_start long, other_end long, similarity double"
#: Pairs that are compared in one piece, about; documents' bytes that are sent at a time.
PIECE, SENT = 1000, 4_000_000


def laid(h: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, int]:
    """An array that holds h at the shingles of the intervals, and how many of its entries end with those that h has."""
    place = places(spans)
    out = np.zeros(int(place[-1]) + 1 if len(place) else 0, h.dtype)
    out[place[: len(h)]] = h
    return out, int(place[len(h) - 1]) + 1 if len(h) else 0


def dealt(pairs: DataFrame) -> DataFrame:
    """Stored pairs with a piece each, about PIECE of them in one: pairs that name the same documents come into the same pieces, as far as these hold them.

    A document's first partner is its star. The pairs of a star are one piece, or, if they are many, so many squares that each holds PIECE.
    """
    tasks, n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count()
    star = pairs.groupBy("id").agg(F.min("other").alias("star"), F.count("*").alias("n"))
    sizes = star.groupBy("star").agg(F.sum("n").alias("n"))
    parts = star.drop("n").join(sizes, "star").select("id", "star", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / PIECE))).alias("parts"))
    part = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col("parts"))
    piece = F.pmod(F.xxhash64("star", part("id", 1), part("other", 2)), F.lit(max(tasks, n // PIECE))).cast("int")
    return stored(pairs.join(parts, "id").select(piece.alias("piece"), "id", "other", "spans", "other_spans"), "dealt")


def verified(pairs: DataFrame, docs: DataFrame, least: int, tenths: int) -> DataFrame:
    """PASSAGES of the documents' pairs (id, other, spans, other_spans: arrays of intervals), which must be stored. A document's hashes (32 bits)
    go to a piece of the pairs once. docs: id and text, or id, h and spans (the hashes of the shingles in these intervals)."""
    whole, pairs = "text" in docs.columns, dealt(pairs)
    sides = pairs.select(F.col("id").alias("key"), "piece", "spans").unionByName(pairs.select(F.col("other").alias("key"), "piece", F.col("other_spans").alias("spans")))
    uses = sides.groupBy("key").agg(F.collect_list(F.struct("piece", "spans")).alias("uses"))

    def cut(batches) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            piece, ids, h, spans, sizes = zip(*held, strict=True)
            n = np.array(sizes)
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(spans)))
            return pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(ids, pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(h, pa.binary()), spans, pa.nulls(len(n), pa.list_(pa.int64()))], list(MEETING))

        held, size = [], 0
        for batch in batches:
            hashes = shingled(batch.column(2)) if whole else (laid(np.frombuffer(h.as_py(), np.uint64), x.values.to_numpy())[0] for h, x in zip(batch.column(2), batch.column(3), strict=True))
            for key, uses, h in zip(batch.column(0).to_pylist(), batch.column(1), hashes, strict=True):
                piece, lists = uses.values.field("piece").to_numpy(), uses.values.field("spans")
                order = np.argsort(piece, kind="stable")
                lists = lists.take(pa.array(order))
                named, begin = np.unique(piece[order], return_index=True)
                offsets = lists.offsets.to_numpy()
                spans, n = merged_rows(lists.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(np.append(offsets[begin], offsets[-1])))
                at = 0
                for p, k in zip(named.tolist(), n.tolist(), strict=True):
                    own = spans[at : at + k]
                    at += k
                    place = places(own)
                    held.append((p, key, (h[place[place < len(h)]] >> np.uint64(32)).astype(np.uint32).tobytes(), own, k))
                    size += len(held[-1][2]) + 8 * k
                    if size >= SENT:
                        yield send()
                        held, size = [], 0
        if held:
            yield send()

    docs = among(docs, sides, "id", "key")
    cuts = docs.join(uses, docs["id"] == uses["key"]).select("id", "uses", *(["text"] if whole else ["h", "spans"])).mapInArrow(cut, ", ".join(f"{k} {v}" for k, v in MEETING.items()))
    met = cuts.unionByName(pairs.withColumn("h", F.lit(None).cast("binary")).select(*MEETING))

    def check(batches) -> Iterator[pa.RecordBatch]:
        now, held, full, marks, rows = None, {}, {}, None, []
        for batch in batches:
            piece, ids, other = (batch.column(i).to_pylist() for i in range(3))
            lists = [batch.column(i) for i in (4, 5)]
            (a, ends_a), (b, ends_b) = ((x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in lists)
            for i, (p, x, y) in enumerate(zip(piece, ids, other, strict=True)):
                if p != now:
                    now, held, full = p, {}, {}
                own = a[ends_a[i] : ends_a[i + 1]]
                if y is None:
                    held[x] = np.frombuffer(batch.column(3)[i].as_py(), np.uint32), own
                    continue
                if not full:
                    code, n = codes(np.concatenate([h for h, _ in held.values()]) if held else np.zeros(0, np.uint32))
                    marks, at = Marks(n), 0
                    for k, (h, spans) in held.items():
                        full[k] = laid(code[at : at + len(h)], spans)
                        at += len(h)
                    held = {}
                if x not in full or y not in full:
                    continue
                (code_x, end_x), (code_y, end_y) = full[x], full[y]
                at_x, at_y = places(own), places(b[ends_b[i] : ends_b[i + 1]])
                at_x, at_y = at_x[: np.searchsorted(at_x, end_x)], at_y[: np.searchsorted(at_y, end_y)]
                rows += [(x, c, d + SHINGLE, y, e, f + SHINGLE, s) for c, d, e, f, s in compare(code_x[at_x], at_x, code_y[at_y], at_y, least, tenths, marks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if i == 6 else pa.int64()) for i, v in enumerate(zip(*rows, strict=True))], ["id", "start", "end", "other_id", "other_start", "other_end", "similarity"])
                rows = []
        tidy()

    return met.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "piece").sortWithinPartitions("piece", F.col("other").isNotNull()).mapInArrow(check, PASSAGES)


#: A row is a document that comes to a piece (h, intervals in spans), or, with `other`, a pair that is compared there.
MEETING = {"piece": "int", "id": "long", "other": "long", "h": "binary", "spans": "array<long>", "other_spans": "array<long>"}


def checked(met: DataFrame, texts: DataFrame, least: int, tenths: int) -> DataFrame:
    """Stored PASSAGES of the rows (id, span, other, other_span) of met, taken together for each pair."""

    def join(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for i in (2, 3):
                column = batch.column(i)
                offsets = column.offsets.to_numpy()
                spans, n = merged_rows(column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets))
                both.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(spans)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], ["id", "other", "spans", "other_spans"])

    sets = met.groupBy("id", "other").agg(F.collect_set("span").alias("spans"), F.collect_set("other_span").alias("other_spans"))
    pairs = stored(sets.mapInArrow(join, "id long, other long, spans array<long>, other_spans array<long>"), "pairs")
    return stored(verified(pairs, texts, least, tenths), "passages")


def unmatched(met: DataFrame, good: DataFrame, first, last) -> DataFrame:
    """Rows of met whose shingles `first` to `last` overlap no passage of the pair (id, other)."""
    hits = good.groupBy("id", F.col("other_id").alias("other")).agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("hits"))
    return met.join(hits, ["id", "other"], "left").where(F.col("hits").isNull() | ~F.exists("hits", lambda h: (h["a"] <= last) & (h["b"] > first))).drop("hits")


def rare_places(h: np.ndarray, of: np.ndarray, first: int, last: int, least: int, tenths: int) -> np.ndarray:
    """Shingles first..last that are among the rarest of some `least` in a row: so many that passages alike share one of them.

    Of `least` shingles in a row of a passage as many may lack in the other passage as its share allows; of one more, some is shared.
    """
    own = h[first : last + 1]
    n = least - -(-2 * tenths * least // (10 + tenths)) + 1
    mask = np.uint64((1 << max(len(own) - 1, 1).bit_length()) - 1)
    order = (of[(own & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(55)) | (mixed(own) >> np.uint64(9))
    order = (order & ~mask) | np.arange(len(own), dtype=np.uint64)
    out = []
    for at in range(0, len(own) - least + 1, 50_000):
        part = np.lib.stride_tricks.sliding_window_view(order[at : at + 50_000 + least - 1], least)
        out.append(np.unique(np.partition(part, n - 1, axis=1)[:, :n] & mask))
    return np.unique(np.concatenate(out)).astype(np.int64) + first if out else np.zeros(0, np.int64)


def rare_windows(parts: DataFrame, least: int, tenths: int) -> DataFrame:
    """(id, sig, at, span, open) of the rare shingles of each document's spans. parts, stored: id, h (hashes in the spans), spans, opens (those not yet matched)."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for h in batch.column(0):
                sums += np.bincount((np.frombuffer(h.as_py(), np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["bucket", "n"])

    rows = parts.select("h").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(BUCKETS, np.int64)
    sums[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    sent = parts.sparkSession.sparkContext.broadcast(np.minimum(np.log2(sums + 1) * 8, 511).astype(np.uint64))  # BUCKETS counters

    def read(batches) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            rows = []
            for key, h, spans, opens in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in ("h", "spans", "opens")), strict=True):
                h, undone = laid(np.frombuffer(h.as_py(), np.uint64), spans.values.to_numpy())[0], merged(opens.as_py())
                for first, last in ((x >> 32, x & 0xFFFFFFFF) for x in spans.as_py()):
                    at = rare_places(h, of, first, min(last, len(h) - 1), least, tenths)
                    if len(at):
                        near = np.zeros(len(at), bool)
                        for a, b in undone:
                            near |= (at >= a) & (at <= b)
                        rows.append((np.full(len(at), key), h[at].view(np.int64), at, np.full(len(at), first << 32 | last), near))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["id", "sig", "at", "span", "open"])

    return parts.select("id", "h", "spans", "opens").mapInArrow(read, "id long, sig long, at long, span long, open boolean")


def settled(found: DataFrame, rest: DataFrame, texts: DataFrame, good: DataFrame, least: int, tenths: int) -> DataFrame:
    """good and the PASSAGES of the windows in rest, which match the first document of no group of theirs, with any member of their groups.

    The members, matched ones too, are grouped again by their rarest shingles, where a common line counts last. Windows are compared
    with the first document of such a group, those left with the first of themselves as long as that settles many, the others with every member.
    There the first of equal texts stands for its copies, and each copy is linked with it.
    """
    open_ = rest.withColumn("open", F.lit(True))
    members = among(found, rest, "sig", "sig").join(rest.select("sig").distinct(), "sig", "left_semi").join(open_, ["sig", "id", "span"], "left")
    spans = members.groupBy("id").agg(F.collect_set("span").alias("spans"), F.collect_set(F.when(F.col("open"), F.col("span"))).alias("opens"))
    spans = stored(spans.withColumnRenamed("id", "key"), "spans")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            offsets, held = column.offsets.to_numpy(), []
            own, n = merged_rows(column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets))
            ends = np.append(0, np.cumsum(n))
            for i, h in enumerate(shingled(batch.column(1))):
                place = places(own[ends[i] : ends[i + 1]])
                held.append(h[place[place < len(h)]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own)), *batch.columns[3:]], ["id", "h", "spans", "opens", "digest"])

    whole = among(texts, spans, "id", "key").dropDuplicates(["id"]).join(spans, F.col("id") == F.col("key")).select("id", "text", "spans", "opens", F.unhex(F.sha2("text", 256)).alias("digest"))
    parts = stored(whole.mapInArrow(cut, "id long, h binary, spans array<long>, opens array<long>, digest binary"), "parts")
    texts = parts.select("id", "h", "spans")
    all_rare = rare_windows(parts, least, tenths)
    rare = stored(all_rare.groupBy("id", "sig").agg(F.min("at").alias("at"), F.max(F.struct("open", "span")).alias("w")).select("id", "sig", "at", "w.span", "w.open"), "rare")
    every = rare.groupBy("sig").agg(F.bool_or("open").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("sig")
    rare = stored(rare.join(every, "sig", "left_semi"), "members")
    now, was = rare, None
    while True:
        lead = now.groupBy("sig").agg(F.min(F.struct("id", "span", "open")).alias("f"), F.max("id").alias("last")).where("f.id < last").select("sig", F.col("f.id").alias("other"), F.col("f.span").alias("other_span"), F.col("f.open").alias("other_open"))
        met = stored(now.join(lead, "sig").where("id <> other and (open or other_open)").select("sig", "id", "at", "span", "open", "other", "other_span"), "met")
        if met.isEmpty():
            return good
        new = checked(met, texts, least, tenths)
        good = good.unionByName(new)
        now = stored(unmatched(met.where("open"), new, F.col("at"), F.col("at")).select("id", "sig", "at", "span", "open"), "left")
        left = now.count()
        if not left:
            return good
        if was is not None and left > 0.7 * was:
            break
        was = left
    same = parts.groupBy("digest").agg(F.min("id").alias("same"))
    copies = stored(parts.select("id", "digest").join(same, "digest").select("id", "same"), "copies")
    class_of = lambda rows: rows.join(copies, "id").select("sig", "same", "span").distinct()
    both = class_of(now).withColumnRenamed("same", "id").join(class_of(rare).select("sig", F.col("same").alias("to"), F.col("span").alias("to_span")), "sig").where("id <> to")
    here, there = F.struct("id", "span"), F.struct(F.col("to").alias("id"), F.col("to_span").alias("span"))
    pairs = both.select(F.greatest(here, there).alias("x"), F.least(here, there).alias("y"))
    pairs = stored(pairs.select(F.col("x.id").alias("id"), "x.span", F.col("y.id").alias("other"), F.col("y.span").alias("other_span")).distinct(), "classes")
    named = pairs.select(F.col("id").alias("same")).union(pairs.select("other")).union(now.join(copies, "id").select("same")).distinct()
    linked = good.select("id", F.col("other_id").alias("same")).distinct()
    lone = copies.where("id <> same").join(named, "same", "left_semi").join(linked, ["id", "same"], "left_anti")
    lone = parts.select("id", F.explode("spans").alias("span")).join(lone, "id").select("id", "span", F.col("same").alias("other"), F.col("span").alias("other_span"))
    return good.unionByName(checked(pairs.unionByName(lone), texts, least, tenths))


def repeated_passages(docs: DataFrame, min_words: int = 50, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage found in two documents: id, start, end (words, end exclusive), other_id (an earlier document), other_start,
    other_end, similarity.

    A passage has min_words words or more, and its five-word shingles have a Jaccard similarity of tenths/10 or more with those of the
    other passage. Words are lower-cased and split at white space. Exact repeats always share their signatures; of near repeats at the
    threshold a few are missed, as their min-hashes may differ. A document is linked to the first document of a group of repeats that it matches; one that does not match the first is compared with the other members. Null and shorter
    texts hold no passage; rows with equal id and text count as one document, unlike texts that share an id, or have none, as several; of two
    documents the one of the smaller id (null first) is the earlier; an empty table gives no rows; other columns are not read.
    """
    with shuffles_freed(docs.sparkSession):
        texts, names = documents(docs, id_col, text_col)
        out = _repeated(texts, min_words - SHINGLE + 1, tenths)
    if names is not None:  # back from keys to ids; the later document comes first
        for side in ("id", "other_id"):
            own = names.select(F.col("key").alias("_key"), F.col("id").alias("_id"), F.lit(True).alias("_named"))
            out = out.join(own, F.col(side) == F.col("_key"), "left").withColumn(side, F.when(F.col("_named"), F.col("_id")).otherwise(F.col(side))).drop("_key", "_id", "_named")
        here, there = F.struct("id", "start", "end"), F.struct(F.col("other_id").alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))
        out = out.select(F.greatest(here, there).alias("a"), F.least(here, there).alias("b"), "similarity")
        out = out.select("a.*", F.col("b.id").alias("other_id"), F.col("b.start").alias("other_start"), F.col("b.end").alias("other_end"), "similarity")
    return out.distinct().withColumnsRenamed({"id": id_col, "other_id": f"other_{id_col}"})


def documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) under ids that name one text each, and (key, id) of those documents, if there are any, that took a key of their own: a hash
    of id and text for null ids and for ids with unlike texts."""
    rows = keyed_texts(docs, id_col, text_col)
    h = F.xxhash64("text")
    odd = stored(rows.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("id IS NULL OR a <> b").select(F.col("id").alias("odd"), F.lit(True).alias("is_odd")), "odd")
    if odd.isEmpty():
        return rows, None
    rows = rows.join(odd, F.col("id").eqNullSafe(F.col("odd")), "left").withColumn("key", F.when(F.col("is_odd"), F.xxhash64("id", "text", F.lit("passage"))).otherwise(F.col("id")))
    return rows.select(F.col("key").alias("id"), "text"), stored(rows.where("is_odd").select("key", "id").distinct(), "names")


def _repeated(texts: DataFrame, least: int, tenths: int) -> DataFrame:
    """PASSAGES of (id, text)."""
    span = lambda first, last: F.shiftleft(F.col(first).cast("long"), 32).bitwiseOR(F.col(last).cast("long"))
    found = stored(groups(windows(texts, least)), "groups").select("sig", "id", span("first", "last").alias("span"), "other", span("other_first", "other_last").alias("other_span"))
    met = found.where("id <> other")
    out = None
    if not met.isEmpty():
        out = checked(met, texts, least, tenths)
        rest = stored(unmatched(met, out, F.shiftright("span", 32), F.col("span").bitwiseAND(0xFFFFFFFF)).select("sig", "id", "span").distinct(), "open")
        if not rest.isEmpty():
            out = settled(found.select("sig", "id", "span"), rest, texts, out, least, tenths)
    if out is None:
        out = texts.sparkSession.createDataFrame([], PASSAGES)
    return out
