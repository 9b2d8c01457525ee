"""Phrases that occur more often than their parts suggest, for each language.

The first pass deals hashes of all n-grams out by their leading bits. Each hash partition keeps a Misra-Gries summary whose capacity exceeds
the partition's mass divided by the threshold, so no frequent n-gram is lost; what survives becomes a bitmap of bounded size. The second pass
counts, exactly and by their words, the n-grams that the bitmap lets through. Cuts, scores, containment and ranks are joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import mixed, span_hashes, stored, tidy

#: Words in a phrase at the most.
LONGEST = 4
#: Bytes of text that are worked on together, and n-grams whose hashes are sorted and sent off together.
BLOCK, FLUSH = 1_000_000, 4_000_000
#: n-grams that a hash partition is meant for, and partitions at the most.
SHARE, PARTS = 4_000_000, 1 << 17
#: Bits of the survivors' bitmap at the most: 32 MB, whatever the input. Where survivors fill it, more n-grams are counted and none is lost.
BITS = 28
#: Hashes of n-grams known to be frequent that a task leaves out from then on.
SURE = 500_000
#: Counters stop here; every threshold must be well below.
FULL = 255

# What ends a piece, and what lies between words.
SEPARATORS = b".,;:!?\n\v\f\r"
BLANKS = b" \t"
WORD = np.ones(256, bool)
WORD[list(SEPARATORS + BLANKS)] = False
BREAKS = np.zeros(256, bool)
BREAKS[list(SEPARATORS)] = True
GAP = re.compile(b"[ \t.,;:!?\n\v\f\r]")
TAIL = re.compile(rb"(?:[ \t.,;:!?\n\v\f\r]*[^ \t.,;:!?\n\v\f\r]+){0,%d}" % (LONGEST - 1))
TO_SPACES = bytes(0x20 if b in SEPARATORS + BLANKS else b for b in range(256))
STEP = np.uint64(0xD6E8FEB86659FD93)


def blocks(batches) -> Iterator[tuple[bytes, list[int], list[str], int]]:
    """(lower-cased bytes, where texts end, their languages, byte before which an n-gram may start) for about BLOCK bytes at a time.

    Texts are joined by a line feed, which separates pieces. A longer text comes in several blocks, each followed by the words that its
    last n-grams need.
    """
    held, ends, langs, size = [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            lang, text = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or b"").lower()
            if len(text) > BLOCK:
                at = 0
                while at < len(text):
                    gap = GAP.search(text, at + BLOCK)
                    end = gap.start() if gap else len(text)
                    last = TAIL.match(text, end).end()
                    yield text[at:last], [last - at], [lang], end - at
                    at = end
                continue
            held.append(text)
            size += len(text) + 1
            ends.append(size)
            langs.append(lang)
            if size > BLOCK:
                yield b"\n".join(held), ends, langs, size
                held, ends, langs, size = [], [], [], 0
    if held:
        yield b"\n".join(held), ends, langs, size


class Words:
    """The words of a block: where they start, which piece break lies before each, their texts' languages."""

    def __init__(self, raw: bytes, ends: list[int], langs: list[str], limit: int):
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.raw, self.data, self.start, self.end = raw, data, edges[::2], edges[1::2]
        self.n = len(self.start)
        breaks = np.cumsum(BREAKS[data], dtype=np.int32)
        self.broken = np.ones(self.n, bool)  # a piece ends before the word
        if self.n:
            self.broken[1:] = breaks[self.start[1:]] != breaks[self.end[:-1] - 1]
        code, self.langs = pd.factorize(np.array(langs, dtype=object))
        self.lang = code[np.searchsorted(ends, self.start, side="right").clip(max=len(ends) - 1)] if self.n else np.zeros(0, np.int64)
        self.firsts = int(np.searchsorted(self.start, limit))  # words at which an n-gram may start

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, starts, hashes) of the n-grams of each length."""
        own = span_hashes(self.data, self.start, self.end)
        salt = np.array([int.from_bytes(x.encode("utf-8", "surrogatepass")[:256], "little") % ((1 << 61) - 1) for x in self.langs], np.uint64)
        h = mixed(own[: self.firsts] ^ mixed(salt * STEP + np.uint64(1))[self.lang[: self.firsts]])
        at = np.arange(self.firsts)
        yield 1, at, h
        for words in range(2, LONGEST + 1):
            kept = at + words - 1 < self.n
            at, h = at[kept], h[kept]
            kept = ~self.broken[at + words - 1]
            at, h = at[kept], h[kept]
            h = mixed(h * STEP + own[at + words - 1])
            yield words, at, h


def packed(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order and how often each occurs (FULL at most), as key * 256 + count. keys is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.minimum(np.diff(np.append(first, len(keys))), FULL).astype(np.uint64)
    return keys[first] << np.uint64(8) | counts


class Summary:
    """A Misra-Gries summary of packed keys; merging adds counters, and pruning takes one off each.

    `off` is what pruning took off, so a key occurs `off` times more than its counter says at the most, and one without a counter at most
    `off` times. Each pruning takes more than `capacity` from the mass, so with a capacity above mass / threshold `off` stays below the
    threshold. It is never let reach it: the summary grows instead.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.off, self.keys = capacity, threshold, 0, np.zeros(0, np.uint64)

    def merge(self, other: np.ndarray) -> None:
        keys = np.sort(np.concatenate([self.keys, other]))
        if len(keys):
            key = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            counts = np.minimum(np.add.reduceat(keys & np.uint64(FULL), first), np.uint64(FULL))
            keys = key[first] << np.uint64(8) | counts
        while len(keys) > self.capacity and self.off + 1 < self.threshold:
            keys = keys[(keys & np.uint64(FULL)) > 1] - np.uint64(1)
            self.off += 1
        self.keys = keys

    def survivors(self) -> np.ndarray:
        """Every key that may have reached the threshold."""
        return self.keys[(self.keys & np.uint64(FULL)) + np.uint64(self.off) >= np.uint64(self.threshold)] >> np.uint64(8)


def survivors(texts: DataFrame, threshold: int, bits: int, shares: int, width: int, capacity: int) -> bytes:
    """The bitmap of the leading `bits` of the hashes of all n-grams that occur `threshold` times or more, and of few others."""
    drop, within = np.uint64(64 - width), width - shares  # a hash keeps `width` bits, of which the first `shares` name its partition

    def send(batches) -> Iterator[pa.RecordBatch]:
        held, size, sure = [], 0, np.zeros(0, np.uint64)

        def flush() -> pa.RecordBatch:
            nonlocal held, size, sure
            keys = np.concatenate(held)
            held, size = [], 0
            found = packed(keys)
            del keys
            key = found >> np.uint64(8)
            if len(sure):
                at = np.searchsorted(sure, key).clip(max=len(sure) - 1)
                found = found[sure[at] != key]
                key = found >> np.uint64(8)
            known = key[(found & np.uint64(FULL)) >= np.uint64(threshold)]
            if len(sure) + len(known) <= SURE:
                sure = np.sort(np.concatenate([sure, known]))
            part = (key >> np.uint64(within)).astype(np.int64)
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                gaps = np.diff(key[a:b], prepend=np.uint64(int(part[a]) << within))
                planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)  # gaps byte by byte: the upper ones are zeros
                used = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                rows.append((int(part[a]), used, planes[:used].tobytes(), (found[a:b] & np.uint64(FULL)).astype(np.uint8).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["part", "used", "gaps", "counts"])

        for block in blocks(batches):
            for _, _, h in Words(*block).grams():
                held.append(h >> drop)
                size += len(h)
            if size >= FLUSH:
                yield flush()
        if held:
            yield flush()
        tidy()

    def summarise(batches) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Summary] = {}
        waiting: dict[int, list] = {}

        def merge(part: int) -> None:
            kept.setdefault(part, Summary(capacity, threshold)).merge(np.concatenate(waiting.pop(part)))

        for batch in batches:
            for row in batch.to_pylist():
                n, part = len(row["counts"]), row["part"]
                planes = np.zeros((8, n), np.uint8)
                planes[: row["used"]] = np.frombuffer(row["gaps"], np.uint8).reshape(row["used"], n)
                gaps = np.ascontiguousarray(planes.T).view("<u8").ravel()
                gaps[0] += np.uint64(part << within)
                found = waiting.setdefault(part, [])
                found.append(np.cumsum(gaps, dtype=np.uint64) << np.uint64(8) | np.frombuffer(row["counts"], np.uint8))
                if sum(map(len, found)) >= capacity:
                    merge(part)
        for part in list(waiting):
            merge(part)
        for part, summary in kept.items():
            index = (summary.survivors() >> np.uint64(width - bits)).astype(np.int64) - (part << (bits - shares))
            flags = np.zeros(1 << (bits - shares), bool)
            flags[index] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        tidy()

    sent = texts.mapInArrow(send, "part long, used int, gaps binary, counts binary")
    rows = sent.repartition("part").mapInArrow(summarise, "part long, bits binary")
    bitmap, size = bytearray(1 << (bits - 3)), 1 << (bits - shares - 3)
    for row in rows.collect():
        bitmap[row["part"] * size : (row["part"] + 1) * size] = row["bits"]
    return bytes(bitmap)


def frequent(docs: DataFrame, threshold: int = 30, lang_col: str = "lang", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """(lang, words, phrase, n): how often each n-gram of 1 to 4 words occurs, of those that do so `threshold` times or more; with words 0
    and an empty phrase, the number of all words of a language.

    `capacity` is that of a partition's summary; by default twice its expected mass divided by the threshold.
    """
    if not 1 < threshold < FULL - threshold:
        raise ValueError(f"a threshold of 2 to {(FULL - 1) // 2}")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    mass = LONGEST * int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 6 + 1  # a word and what follows it are about six bytes
    bits = min(max(mass.bit_length() + 2, 16), BITS)
    shares = min(max((mass // SHARE).bit_length(), 2), PARTS.bit_length() - 1, bits - 8)
    width = min(max(mass.bit_length() + 4, bits), 56)
    bitmap = spark.sparkContext.broadcast(survivors(texts, threshold, bits, shares, width, capacity or max(1 << 16, 2 * (mass >> shares) // threshold)))
    shift = np.uint64(64 - bits)

    def count(batches) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(bitmap.value, np.uint8)
        for block in blocks(batches):
            words = Words(*block)
            if not words.n:
                continue
            tokens = block[0].translate(TO_SPACES).split()
            code = pd.factorize(np.array(tokens, dtype=object))[0].astype(np.int64)
            many, out = int(code.max()) + 1, []
            for lang, n in zip(words.langs.tolist(), np.bincount(words.lang[: words.firsts], minlength=len(words.langs)).tolist(), strict=True):
                out.append((lang, 0, b"", n))
            before = None  # the code of the n-gram one word shorter at each word, -1 where it is not frequent
            for size, at, h in words.grams():
                index = h >> shift
                passed = (found[(index >> np.uint64(3)).astype(np.int64)] >> (index & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if size > 1:  # both n-grams inside are frequent if this is; the second may start past the block's own words
                    inner = at + 1 < words.firsts
                    passed &= (before[at] >= 0) & ((before[np.where(inner, at + 1, at)] >= 0) | ~inner)
                at = at[passed]
                key = (before[at] if size > 1 else words.lang[at]) * many + code[at + size - 1]
                own, distinct = pd.factorize(key)
                where = np.zeros(len(distinct), np.int64)
                where[own[::-1]] = at[::-1]  # each one's first place
                for i, n in zip(where.tolist(), np.bincount(own, minlength=len(distinct)).tolist(), strict=True):
                    out.append((words.langs[words.lang[i]], size, b" ".join(tokens[i : i + size]), n))
                before = np.full(words.n, -1, np.int64)
                before[at] = own
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], ["lang", "words", "phrase", "n"])
        tidy()

    rows = texts.mapInArrow(count, "lang string, words int, phrase binary, n long")
    totals = rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= threshold))
    return stored(totals.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n"), "phrases")


def wide(column) -> F.Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """Each language's best `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 4 words that occurs a >= threshold times scores floor(2000000 a / (l + r)), where l and r count the two parts at the
    cut that scores lowest (ties: the earliest cut). A phrase inside a longer one that occurs at least share % as often is left out. Ranks go
    by score, a (both falling) and phrase (by its bytes). A null language is `und`, a null text is empty; equal rows count each; other
    columns are not read; an empty table gives no rows, and so does a language without a phrase.
    """
    counts = frequent(docs, threshold, lang_col, text_col, capacity)
    word = F.split("phrase", " ")
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), word.alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = lambda name, n: counts.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = phrases.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * wide("f") < share * wide("a")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(512)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
