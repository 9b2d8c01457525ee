"""Line deduplication by an exact set-similarity join over the lines' tokens.

A line's tokens are its distinct lower-cased words, kept as hashes and ordered by rarity. Lines with equal token sets form a class,
represented by its first line. Two classes whose Jaccard similarity reaches the threshold share a token among their rarest ones (the
prefix), so a representative leaves one posting for each prefix token. Where the postings of a token meet, length, positional and bitmap
filters leave candidates, whose similarity is then computed from the lines themselves. A line with an earlier match goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import hashed_words, held, keyed_texts, mixed, plain_bytes, stored, tidy

#: Counters of the rarity sketch, and those of one of its pieces; their number does not depend on the input.
COUNTERS, PIECE = 1 << 22, 1 << 12
#: Characters that are worked on at a time.
STEP = 250_000
#: Tokens above which a line's parity map has four words instead of one.
WIDE = 64
#: Postings that are sent off together, and mean postings of a bucket, where they are sorted and meet.
FLUSH, BUCKET = 80_000, 100_000
#: Pairs that are looked at together.
PAIRS = 120_000
#: Class of rarity (8 for each doubling) from which a token may have too many postings for its bucket: such tokens are counted exactly and dealt.
HOT = 8 * 14
#: Postings of a hot token that are kept together; two such groups meet at a time.
GROUP = 4096
#: Candidates that a line takes from a bucket in the first pass; a line with more and no match among them is searched in full.
FIRST = 4
#: Bytes up to which the smaller side of a join is broadcast; a larger one is shuffled.
SMALL = 128 << 20

PLACE = ["id", "tie", "line"]
TO = ["to_id", "to_tie", "to_line"]
PAIR_SCHEMA = "id long, tie long, line int, to_id long, to_tie long, to_line int"


def tokens_of(line: str) -> set[str]:
    return set(line.lower().split())


def documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, tie, text), a row for each id and text, and the ids (`again`) of several rows, if there are any. tie is 0 for any other id and
    for these a hash of the text, so unlike texts of one id stay apart."""
    rows = keyed_texts(docs, id_col, text_col)
    again = stored(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"), F.lit(True).alias("many")), "again")
    if again.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("tie"), "text"), None
    rows = rows.join(limited(again, F.lit(24)), F.col("id").eqNullSafe(F.col("again")), "left")
    several = rows.where("many").select("id", F.xxhash64("text").alias("tie"), "text").groupBy("id", "tie").agg(F.min("text").alias("text"))
    return rows.where("many is null").select("id", F.lit(0).cast("long").alias("tie"), "text").unionByName(several), again


def limited(df: DataFrame, size) -> DataFrame:
    """df, marked for a broadcast if its rows, of `size` bytes each, have SMALL bytes or fewer in all. df must be cheap to read (a stored table)."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SMALL else df


def _steps(batches, keys: list[str]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of about STEP characters at a time; a longer text comes alone."""
    for batch in batches:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
        some, texts, held = [], [], 0
        for key, text in zip(own, batch.column("text"), strict=True):
            some.append(key)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= STEP:
                yield some, texts
                some, texts, held = [], [], 0
        if texts:
            yield some, texts


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """Class of each of COUNTERS hash values by the occurrences of its tokens in all texts: 8 classes for each doubling, so of two tokens
    the one of the lower class is the rarer as far as the sketch can tell.

    Each task counts all its texts; its counters are added up in two steps, so no group grows with the number of tasks beyond their 256th part.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        held()
        sums, own, size = np.zeros(COUNTERS, np.uint32), [], 0

        def add() -> None:
            nonlocal own, size
            at = np.concatenate(own)
            own, size = [], 0
            at.sort()
            first = np.flatnonzero(np.append(len(at) > 0, at[1:] != at[:-1]))
            sums[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)

        for _, texts in _steps(batches, []):
            h, _, _ = hashed_words(plain_bytes("\n".join(texts)))
            own.append(counter_of(h >> np.uint64(20)))
            size += len(h)
            if size >= COUNTERS // 8:
                add()
        if own:
            add()
        pieces = sums.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        part = TaskContext.get().partitionId() // 256
        for at in range(0, len(used), 64):
            some = used[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), part, np.int32)), pa.array([pieces[i].astype("<u8").tobytes() for i in some], pa.binary())], ["piece", "part", "n"])
        tidy()

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(PIECE, np.uint64)
        for x in table["n"]:
            out += np.frombuffer(x.as_buffer(), "<u8")
        return out

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"piece": table["piece"][:1], "n": pa.array([total(table).tobytes()], pa.binary())})

    def all_of(table: pa.Table) -> pa.Table:
        classes = np.minimum(np.log2(total(table) + 1.0) * 8, 255).astype(np.uint8)
        return pa.table({"piece": table["piece"][:1], "n": pa.array([classes.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "piece int, part int, n binary").groupBy("piece", "part").applyInArrow(some, "piece int, n binary")
    out = np.zeros((COUNTERS // PIECE, PIECE), np.uint8)
    for piece, n in parts.groupBy("piece").applyInArrow(all_of, "piece int, n binary").collect():  # COUNTERS bytes in all
        out[piece] = np.frombuffer(n, np.uint8)
    return out.ravel()


def least_joined(tenths: int) -> int:
    """Tokens from which on a line may match one of another token set."""
    n = 1
    while -(-(2 * n + 1) * tenths // (10 + tenths)) > n:
        n += 1
    return n


LINE_COLUMNS = [*PLACE, "c1", "c2", "n", "fold", "wide", "prefix"]
LINE_SCHEMA = "id long, tie long, line int, c1 long, c2 long, n int, fold long, wide binary, prefix array<long>"


def line_rows(docs: DataFrame, classes, tenths: int, min_tokens: int) -> DataFrame:
    """One row for each line with min_tokens distinct tokens or more: its place, c1 and c2 (128 bits of its token set), n tokens, fold (a
    map of 64 bits, each the parity of the tokens that fall on it), wide (the same in 256 bits, for more than WIDE tokens; they fold to
    64) and prefix (codes, rarest first): as many tokens that any other set tenths/10 similar has one of them in its own prefix.

    Token sets are told apart by the whole 64-bit hashes of their tokens; the rest takes 44 bits of them. A token's code is its rarity class and 36 of those bits, so sorting line and code in one integer puts
    each line's tokens in order.
    """
    shift, low44, least = np.uint64(44), np.uint64(2**44 - 1), least_joined(tenths)

    def encode(keys: list, texts: list[str], of: np.ndarray) -> pa.RecordBatch | None:
        h, start, data = hashed_words(plain_bytes("\n".join(texts)))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, start).astype(np.uint64)
        order = np.lexsort((h, line))
        line, h = line[order], h[order]
        new = np.ones(len(h), bool)  # the distinct tokens of each line
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        line, h = line[new].astype(np.int64), h[new]
        n = np.bincount(line, minlength=len(breaks) + 1)
        keep = n >= max(min_tokens, 1)
        if not keep.any():
            return None
        if not keep[line].all():
            inside = keep[line]
            line, h = line[inside], h[inside]
        n = n[keep]
        starts = np.cumsum(n) - n
        c1, c2 = np.add.reduceat(mixed(h), starts), np.add.reduceat(mixed(~h), starts)
        token = h >> np.uint64(20)
        spot, word = np.uint64(1) << (token >> np.uint64(38)), token >> np.uint64(36) & np.uint64(3)
        fold = np.bitwise_xor.reduceat(spot, starts)
        big = n > WIDE
        far = np.repeat(big, n)
        wide = np.zeros((int(big.sum()), 4), np.uint64)
        if len(wide):
            at = np.cumsum(n[big]) - n[big]
            for w in range(4):
                wide[:, w] = np.bitwise_xor.reduceat(np.where(word[far] == w, spot[far], np.uint64(0)), at)
        blobs = iter(wide)
        code = (of[(token & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(36)) | (token & np.uint64(2**36 - 1))
        code |= line.astype(np.uint64) << shift
        code.sort()
        size = np.where(n >= least, n - (-(-n * tenths // 10)) + 1, 0)
        ends = np.cumsum(size)
        prefix = (code & low44)[np.repeat(starts - (ends - size), size) + np.arange(ends[-1])]
        lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(prefix.view(np.int64)))
        lines = np.array([t.count("\n") + 1 for t in texts])
        doc = np.repeat(np.arange(len(texts)), lines)[keep]
        number = np.flatnonzero(keep) - (np.cumsum(lines) - lines)[doc]
        own = [pa.array([k[i] for k in keys], pa.int64()).take(pa.array(doc)) for i in range(2)]
        maps = pa.array([next(blobs).tobytes() if x else None for x in big.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([*own, pa.array(number.astype(np.int32)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(fold.view(np.int64)), maps, lists], LINE_COLUMNS)

    def parts(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str], int]]:
        """Pieces of fewer than 2**20 lines, with the number of the first line."""
        if sum(t.count("\n") + 1 for t in texts) < 2**20:
            yield keys, texts, 0
            return
        for key, text in zip(keys, texts, strict=True):
            own = text.split("\n")
            for at in range(0, len(own), 2**19):
                yield [key], ["\n".join(own[at : at + 2**19])], at

    def read(batches) -> Iterator[pa.RecordBatch]:
        held()
        of = classes.value
        for keys, texts in _steps(batches, ["id", "tie"]):
            for some, own, at in parts(keys, texts):
                rows = encode(some, own, of)
                if rows is not None:
                    yield rows.set_column(2, "line", pa.array(rows.column(2).to_numpy() + np.int32(at))) if at else rows
        tidy()

    return docs.select("id", "tie", "text").mapInArrow(read, LINE_SCHEMA)


class Postings:
    """Postings in columns: token, place (id, null, tie, line), n tokens of the line, position of the token, fold, and wide (a row each, zero for narrow lines)."""

    FIELDS = (("token", "<i8"), ("id", "<i8"), ("tie", "<i8"), ("fold", "<u8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("null", "u1"))

    def __init__(self, columns: dict[str, np.ndarray], wide: np.ndarray):
        self.c, self.wide = columns, wide

    def __len__(self) -> int:
        return len(self.c["n"])

    def take(self, at: np.ndarray) -> Postings:
        return Postings({k: v[at] for k, v in self.c.items()}, self.wide[at])

    @classmethod
    def of_lines(cls, rows: pa.RecordBatch) -> Postings:
        """One posting for each prefix token of the rows (LINE_COLUMNS)."""
        lists = rows.column("prefix")
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.zeros((len(sizes), 4), np.uint64)
        for i, x in enumerate(rows.column("wide")):
            if x.is_valid:
                wide[i] = np.frombuffer(x.as_buffer(), np.uint64)
        columns = {"token": lists.flatten().to_numpy(), "pos": pos.astype(np.int32)} | place_columns(rows, row)
        return cls(columns, wide[row])

    def pack(self, a: int, b: int) -> bytes:
        big = self.c["n"][a:b] > WIDE
        return b"".join([*(self.c[k][a:b].astype(t, copy=False).tobytes() for k, t in self.FIELDS), self.wide[a:b][big].tobytes()])

    @classmethod
    def unpack(cls, blobs: list[tuple[int, memoryview]]) -> Postings:
        """Of (number of postings, bytes) pairs."""
        parts, wides = {k: [] for k, _ in cls.FIELDS}, []
        for m, data in blobs:
            at = 0
            for k, t in cls.FIELDS:
                parts[k].append(np.frombuffer(data, t, m, at))
                at += m * np.dtype(t).itemsize
            wide = np.zeros((m, 4), np.uint64)
            wide[parts["n"][-1] > WIDE] = np.frombuffer(data, np.uint64, offset=at).reshape(-1, 4)
            wides.append(wide)
        return cls({k: np.concatenate(v) for k, v in parts.items()}, np.concatenate(wides))


def place_columns(rows, at: np.ndarray) -> dict[str, np.ndarray]:
    ids = rows.column("id")
    null = np.asarray(ids.is_null()).astype(np.uint8)
    columns = {"id": ids.fill_null(0).to_numpy(), "null": null, "tie": rows.column("tie").to_numpy(), "line": rows.column("line").to_numpy(), "n": rows.column("n").to_numpy(), "fold": rows.column("fold").to_numpy().view(np.uint64)}
    return {k: v[at] for k, v in columns.items()}


def candidates(p: Postings, tenths: int, first: int, side: np.ndarray | None = None) -> pa.RecordBatch:
    """Pairs among the postings of each token that pass the filters: for each line the `first` earliest earlier ones, and whether there are more.

    With side, only lines of different sides meet, or of side 2.
    """
    order = np.lexsort((p.c["n"], p.c["token"]))
    p = p.take(order)
    group = p.c["token"]
    n, pos, fold, wide = p.c["n"].astype(np.int64), p.c["pos"].astype(np.int64), p.c["fold"], p.wide
    # places as ranks: null ids first
    by = np.lexsort((p.c["line"], p.c["tie"], p.c["id"], 1 - p.c["null"].astype(np.int8)))
    new = np.zeros(len(by), bool)
    for k in ("id", "tie", "line", "null"):
        v = p.c[k][by]
        new[1:] |= v[1:] != v[:-1]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    run = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    key = run << 32 | n
    last = np.searchsorted(key, run << 32 | n * 10 // tenths, side="right")  # lines too long for this one lie beyond
    many = last - np.arange(len(n)) - 1
    sums = np.concatenate([[0], np.cumsum(many)])
    found = np.zeros((2, 0), np.int64)
    at, kept = 0, []

    def earliest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (later, earlier) ranks in order, first + 1 for each later one at most."""
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        keep = np.ones(pairs.shape[1], bool)
        keep[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        pairs = pairs[:, keep]
        start = np.flatnonzero(np.concatenate([[True], pairs[0, 1:] != pairs[0, :-1]])) if pairs.shape[1] else np.zeros(0, np.int64)
        number = np.arange(pairs.shape[1]) - np.repeat(start, np.diff(np.concatenate([start, [pairs.shape[1]]])))
        return pairs[:, number <= first], number[number <= first]

    while at < len(n):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, side="right")) - 1)
        x = np.repeat(np.arange(at, end), many[at:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(sums[at:end] - sums[at], many[at:end])
        at = end
        need = -(-(n[x] + n[y]) * tenths // (10 + tenths))  # least overlap at which the similarity is reached
        apart = n[x] + n[y] - 2 * need  # tokens of either line that the other may lack, and so differing parities
        ok = (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need) & (np.bitwise_count(fold[x] ^ fold[y]) <= apart) & (rank[x] != rank[y])
        if side is not None:
            ok &= (side[order][x] != side[order][y]) | (side[order][x] == 2)
        x, y, apart = x[ok], y[ok], apart[ok]
        ok = (n[x] <= WIDE) | (np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= apart)
        x, y = rank[x[ok]], rank[y[ok]]
        kept.append(np.stack([np.maximum(x, y), np.minimum(x, y)]))
        if sum(h.shape[1] for h in kept) > PAIRS:
            kept = [earliest(np.concatenate(kept, axis=1))[0]]
    found, number = earliest(np.concatenate([found, *kept], axis=1))
    spot = by[np.flatnonzero(new | (np.arange(len(by)) == 0))] if len(by) else by  # a posting of each rank
    later, earlier = spot[found[0]], spot[found[1]]
    full = np.isin(found[0], found[0][number == first])
    keep = number < first
    out = []
    for side_at in (later[keep], earlier[keep]):
        out += [pa.array(p.c["id"][side_at], mask=p.c["null"][side_at].astype(bool)), pa.array(p.c["tie"][side_at]), pa.array(p.c["line"][side_at])]
    return pa.RecordBatch.from_arrays([*out, pa.array(full[keep])], [*PLACE, *TO, "full"])


def met_in_buckets(reps: DataFrame, n_buckets: int, tenths: int, first: int = FIRST, hot: int = HOT) -> DataFrame:
    """Candidates among the postings of tokens that are not hot. Postings go to their token's bucket in packed columns."""

    def deal(batches) -> Iterator[pa.RecordBatch]:
        own, size = [], 0

        def send() -> pa.RecordBatch:
            p = Postings({k: np.concatenate([x.c[k] for x in own]) for k, _ in Postings.FIELDS}, np.concatenate([x.wide for x in own]))
            calm = np.flatnonzero(p.c["token"] >> 36 < hot)
            bucket = (mixed(p.c["token"][calm].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            p, bucket = p.take(calm[order]), bucket[order]
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], len(bucket) > 0)) + 1
            starts = np.append(0, ends)[:-1]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array((ends - starts).astype(np.int32)), pa.array([p.pack(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "m", "postings"])

        for batch in batches:
            own.append(Postings.of_lines(batch))
            size += len(own[-1])
            if size >= FLUSH:
                yield send()
                own, size = [], 0
        if own:
            yield send()
            own = []
        tidy()

    def meet(table: pa.Table) -> pa.Table:
        p = Postings.unpack([(m.as_py(), x.as_buffer()) for m, x in zip(table["m"], table["postings"], strict=True)])
        return pa.Table.from_batches([candidates(p, tenths, first)])

    packed = reps.select(*PLACE, "n", "fold", "wide", "prefix").where(F.size("prefix") > 0).mapInArrow(deal, "bucket int, m int, postings binary")
    return packed.groupBy("bucket").applyInArrow(meet, f"{PAIR_SCHEMA}, full boolean")


def met_hot(reps: DataFrame, tenths: int, first: int = FIRST, hot: int = HOT, group: int = GROUP) -> DataFrame | None:
    """Candidates among the postings of hot tokens, which are counted exactly: a token's postings are dealt into groups, which meet two at a time."""
    spots = reps.where((F.size("prefix") > 0) & (F.element_at("prefix", -1) >= F.lit(hot << 36)))
    spots = spots.select(*PLACE, "n", "fold", "wide", F.posexplode("prefix").alias("pos", "token")).where(F.col("token") >= F.lit(hot << 36))
    spots = stored(spots, "hot")
    if spots.isEmpty():
        return None
    subs = spots.groupBy("token").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("subs"))
    own = F.pmod(F.xxhash64(*PLACE), F.col("subs")).cast("int").alias("own")
    rows = spots.join(subs, "token").select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("other"))
    rows = rows.select(*PLACE, "n", "fold", "wide", "pos", "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        at = np.arange(rows.num_rows)
        wide = np.zeros((rows.num_rows, 4), np.uint64)
        for i, x in enumerate(rows.column("wide")):
            if x.is_valid:
                wide[i] = np.frombuffer(x.as_buffer(), np.uint64)
        columns = place_columns(rows, at) | {"token": rows.column("token").to_numpy(), "pos": rows.column("pos").to_numpy()}
        low, high, own = (rows.column(c).to_numpy() for c in ("low", "high", "own"))
        return pa.Table.from_batches([candidates(Postings(columns, wide), tenths, first, np.where(low == high, 2, own == high))])

    return rows.groupBy("token", "low", "high").applyInArrow(meet, f"{PAIR_SCHEMA}, full boolean")


def same_place(a: list[str], b: list[str]):
    return F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1])) & (F.col(a[2]) == F.col(b[2]))


def line_texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, tie, line, text) of the lines named in places: only their documents' texts are cut."""
    wanted = stored(places.groupBy(F.col("id").alias("k"), F.col("tie").alias("t")).agg(F.collect_set("line").alias("lines")), "wanted")
    both = docs.join(limited(wanted, 32 + 4 * F.size("lines")), F.col("id").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))).select("id", "tie", "lines", "text")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, tie, lines, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = text.as_py().split("\n")
                rows += [(key.as_py(), tie.as_py(), i, own[i]) for i in lines.as_py()]
            if rows:
                key, tie, line, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tie, pa.int64()), pa.array(line, pa.int32()), pa.array(text, pa.string())], [*PLACE, "text"])

    return both.mapInArrow(cut, "id long, tie long, line int, text string")


def verified(pairs: DataFrame, texts: DataFrame, tenths: int) -> DataFrame:
    """The places (id, tie, line) of the pairs whose lines' Jaccard similarity reaches the threshold."""
    near = texts.select(*[F.col(c).alias(f"k_{c}") for c in PLACE], "text")
    far = texts.select(*[F.col(c).alias(f"f_{c}") for c in PLACE], F.col("text").alias("to_text"))
    met = pairs.join(near, same_place(PLACE, [f"k_{c}" for c in PLACE])).join(far, same_place(TO, [f"f_{c}" for c in PLACE]))

    def check(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text"), batch.column("to_text"), strict=True):
                a, b = tokens_of(x.as_py()), tokens_of(y.as_py())
                both = len(a & b)
                keep.append(10 * both >= tenths * (len(a) + len(b) - both))
            yield batch.select(PLACE).filter(pa.array(keep, pa.bool_()))

    return met.select(*PLACE, "text", "to_text").mapInArrow(check, "id long, tie long, line int").distinct()


def removed_lines(docs: DataFrame, tenths: int = 8, min_tokens: int = 1, first: int = FIRST, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(id, tie, line) of every line that an earlier line matches. docs: id, tie, text. The result does not depend on first, hot and group."""
    classes = docs.sparkSession.sparkContext.broadcast(rarity(docs))  # COUNTERS bytes
    lines = stored(line_rows(docs, classes, tenths, min_tokens), "lines")
    several = lines.groupBy("c1", "c2").agg(F.min(F.struct(*PLACE)).alias("f"), F.count("*").alias("m")).where("m > 1")
    several = stored(several.select(F.col("c1").alias("s1"), F.col("c2").alias("s2"), "f"), "classes")
    marked = lines.join(limited(several, F.lit(64)), (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")), "left")
    copy = F.col("f").isNotNull() & ~F.struct(*PLACE).eqNullSafe(F.col("f"))
    copies, reps = marked.where(copy).select(*PLACE), marked.where(~copy).select(*LINE_COLUMNS)
    size = lines.agg(F.sum(F.size("prefix"))).first()[0] or 0
    found = met_in_buckets(reps, -(-size // BUCKET) or 1, tenths, first, hot)
    more = met_hot(reps, tenths, first, hot, group)
    found = found if more is None else found.unionByName(more)
    found = stored(found.groupBy(*PLACE, *TO).agg(F.max("full").alias("full")), "found")
    places = found.select(*PLACE).unionByName(found.select(*[F.col(t).alias(c) for t, c in zip(TO, PLACE, strict=True)])).distinct()
    texts = stored(line_texts(places, docs), "texts")
    # each line's earliest candidate is tried first, the others only if that is no match
    earliest = stored(found.groupBy(*PLACE).agg(F.min(F.struct(*TO)).alias("t"), F.max("full").alias("full")).select(*PLACE, "t.*", "full"), "first")
    good = stored(verified(earliest, texts, tenths), "good")
    key = [f"k_{c}" for c in PLACE]
    named = lambda df: limited(df.select(*[F.col(c).alias(k) for c, k in zip(PLACE, key, strict=True)]), F.lit(40))
    without = lambda df, other: df.join(named(other), same_place(PLACE, key), "left_anti")
    tried = earliest.select(*[F.col(c).alias(f"t_{c}") for c in PLACE], F.struct(*TO).alias("tried"))
    others = without(found, good).join(tried, same_place(PLACE, [f"t_{c}" for c in PLACE])).where(~F.struct(*TO).eqNullSafe(F.col("tried"))).select(*PLACE, *TO)
    better = stored(verified(others, texts, tenths), "better")
    matched = good.unionByName(better)
    left = stored(without(without(earliest.where("full"), good), better).select(*PLACE), "left")
    if not left.isEmpty():
        matched = matched.unionByName(searched(left, reps, docs, tenths))
    return copies.unionByName(matched).distinct()


def searched(left: DataFrame, reps: DataFrame, docs: DataFrame, tenths: int) -> DataFrame:
    """Places of the lines in left that any earlier line matches: all postings of their tokens meet them."""
    posting = [*PLACE, "n", "fold", F.posexplode("prefix").alias("pos", "token")]
    key = [f"k_{c}" for c in PLACE]
    own = reps.join(limited(left.select(*[F.col(c).alias(k) for c, k in zip(PLACE, key, strict=True)]), F.lit(40)), same_place(PLACE, key), "left_semi").select(*posting)
    own = stored(own, "own")
    other = reps.select(*posting).select("token", *[F.col(c).alias(t) for c, t in zip(PLACE, TO, strict=True)], F.col("n").alias("to_n"), F.col("fold").alias("to_fold"), F.col("pos").alias("to_pos"))
    need = F.ceil((F.col("n") + F.col("to_n")) * tenths / F.lit(10 + tenths))
    met = other.join(limited(own, F.lit(64)), "token").where(F.struct(*TO) < F.struct(*PLACE)).where(F.least(F.col("n") - F.col("pos"), F.col("to_n") - F.col("to_pos")) >= need)
    met = met.where(10 * F.least("n", "to_n") >= tenths * F.greatest("n", "to_n")).where(F.bit_count(F.col("fold").bitwiseXOR(F.col("to_fold"))) <= F.col("n") + F.col("to_n") - 2 * need)
    met = stored(met.select(*PLACE, *TO).distinct(), "rest")
    places = met.select(*PLACE).unionByName(met.select(*[F.col(t).alias(c) for t, c in zip(TO, PLACE, strict=True)])).distinct()
    return verified(met, stored(line_texts(places, docs), "texts"), tenths)


def dedup_lines(docs: DataFrame, tenths: int = 8, min_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines removed that match an earlier line, and two more columns: n_lines before, n_removed.

    Two lines match if the Jaccard similarity of their distinct lower-cased words is tenths/10 or more; earlier means by id (null first),
    for unlike texts of one id by a hash of the text, then by line number. Lines with fewer than min_tokens distinct words, blank ones
    always, are never compared and stay. Rows with equal id and text count as one document, so neither is a copy of the other. A null text
    stays null, with 0 lines; a document whose lines all go has an empty text; an empty table stays empty; other columns are kept as they
    are (n_lines and n_removed are replaced), whatever their names.
    """
    kept = docs.drop("n_lines", "n_removed")
    rows, again = documents(docs, id_col, text_col)
    gone = removed_lines(rows, tenths, min_tokens).groupBy("id", "tie").agg(F.collect_set("line").alias("gone"))
    gone = stored(gone, "gone")
    # the documents' own columns travel in one struct, so no name of theirs can clash
    own = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("own"))
    key, text = F.col(f"own.`{id_col}`").cast("long"), F.col(f"own.`{text_col}`")
    tie = F.lit(0).cast("long")
    if again is not None:
        own = own.join(limited(again, F.lit(24)), key.eqNullSafe(F.col("again")), "left")
        tie = F.when(F.col("many"), F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))).otherwise(tie)
    both = own.join(limited(gone, 40 + 4 * F.size("gone")), key.eqNullSafe(F.col("id")) & (tie == F.col("tie")), "left")

    @F.pandas_udf("text string, n long")
    def cut(texts: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = []
        for text, away in zip(texts, lines, strict=True):
            if text is None or away is None:
                out.append((None, 0))
                continue
            away, own = set(away), text.split("\n")
            left = [x for i, x in enumerate(own) if i not in away]
            out.append(("\n".join(left), len(own) - len(left)))
        return pd.DataFrame(out, columns=["text", "n"])

    # only the texts that change go to Python
    both = both.withColumn("cut", cut(F.when(F.col("gone").isNotNull(), text), F.col("gone")))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.col("cut.text"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.coalesce(F.col("cut.n"), F.lit(0)).cast("long")
    return both.select(*[new.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in kept.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
