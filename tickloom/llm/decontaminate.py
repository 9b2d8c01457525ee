"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of the benchmark's items is a seed. Passages of the documents around seeds are gathered. Those that hold enough of their item's words
are aligned with it word by word; a passage is a leak if the alignment's score is a given share of the item's score with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import held, keyed_texts, stored

WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds up to which they are sent to every task; more are joined by a shuffle.
MAX_SENT = 500_000
#: Bytes of items up to which they are sent along; cells of an alignment's table that are worked on at a time.
MAX_BYTES, CELLS = 64 << 20, 2_000_000
PASSAGE_SCHEMA = "id long, item long, first long, words array<string>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def seeds_of(items: DataFrame, n: int) -> DataFrame:
    """(item, seed, size): the n-grams of each item's words, and the item's number of words; an item of fewer words is one seed."""

    def grams(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                rows += [(key.as_py(), x, len(words)) for x in {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if x]
            if rows:
                item, seed, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(seed, pa.string()), pa.array(size, pa.int32())], ["item", "seed", "size"])

    return items.mapInArrow(grams, "item long, seed string, size int")


def _cluster(places: list[tuple[int, str]], size: int) -> Iterator[list[tuple[int, str]]]:
    """Seeds of one item in a document, in order of place, apart where more than an item's length lies between them."""
    run = [places[0]]
    for x in places[1:]:
        if x[0] - run[-1][0] > size:
            yield run
            run = []
        run.append(x)
    yield run


def _passages(words: list[str], found: dict, margin: float) -> Iterator[tuple]:
    """found: item -> (size, [(place, seed)]). One passage for each cluster, with the words that the item could cover on either side."""
    for item, (size, places) in found.items():
        for run in _cluster(places, size):
            reach = int(size * margin) + 1
            first = max(0, run[0][0] - reach)
            yield item, first, words[first : run[-1][0] + reach]


def passages(docs: DataFrame, seeds: DataFrame, n: int, sent_along: bool, margin: float = 1.5) -> DataFrame:
    """PASSAGE_SCHEMA rows of every document that holds a seed. docs: id, text; seeds: stored rows of seeds_of, few enough to be sent to the tasks or not."""
    spark, schema = docs.sparkSession, PASSAGE_SCHEMA

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("id", "item", "first", "words"), r, strict=True)) for r in rows], pa.schema([("id", pa.int64()), ("item", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))]))

    if sent_along:
        table: dict[tuple, list] = {}
        for item, seed, size in seeds.collect():
            table.setdefault(tuple(seed.split(" ")), []).append((item, size))
        sent = spark.sparkContext.broadcast(table)

        def scan(batches) -> Iterator[pa.RecordBatch]:
            held()
            own = sent.value
            lengths = sorted({len(k) for k in own})
            keys = own.keys()
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    words, found = words_of(text.as_py()), {}
                    for k in lengths:
                        if keys.isdisjoint(zip(*(words[i:] for i in range(k)), strict=False)):
                            continue
                        for at, gram in enumerate(zip(*(words[i:] for i in range(k)), strict=False)):
                            for item, size in own.get(gram, ()):
                                found.setdefault(item, (size, []))[1].append((at, " ".join(gram)))
                    for places in found.values():
                        places[1].sort()
                    rows += [(key.as_py(), *p) for p in _passages(words, found, margin)]
                if rows:
                    yield batch_of(rows)

        return docs.mapInArrow(scan, schema)

    # more seeds than may be sent: the documents' n-grams go to the seeds, and each document's finds come back to it
    lengths = [r[0] for r in seeds.select(F.size(F.split("seed", " ")).alias("k")).distinct().collect()]

    def grams(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for k in lengths:
                    all_grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
                    for at in range(0, len(all_grams), 10_000):
                        some = all_grams[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], ["id", "at", "seed"])

    hits = docs.mapInArrow(grams, "id long, at long, seed string").join(seeds, "seed")
    finds = hits.groupBy("id").agg(F.collect_list(F.struct("item", "size", "at", "seed")).alias("found")).withColumnRenamed("id", "key")
    both = docs.join(finds, F.col("id").eqNullSafe(F.col("key"))).select("id", "text", "found")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, hits in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, found = words_of(text.as_py()), {}
                for h in sorted(hits.as_py(), key=lambda h: (h["at"], h["seed"])):
                    found.setdefault(h["item"], (h["size"], []))[1].append((h["at"], h["seed"]))
                rows += [(key.as_py(), *p) for p in _passages(words, found, margin)]
            if rows:
                yield batch_of(rows)

    return both.mapInArrow(cut, schema)


def align(items: list[list[str]], texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each item with its text, and the text word at which each best alignment ends (exclusive)."""
    best, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(texts[i])))
    at = 0
    while at < len(order):
        wide, end = 0, at  # as many pairs as their longest text leaves room for
        while end < min(len(order), at + 256) and (end == at or max(wide, len(texts[order[end]])) * (end - at + 1) <= CELLS):
            wide, end = max(wide, len(texts[order[end]])), end + 1
        some, at = order[at:end], end
        code: dict[str, int] = {}
        of = lambda w: code.setdefault(w, len(code))
        a = np.full((len(some), max(len(items[i]) for i in some)), -1)
        b = np.full((len(some), max(len(texts[i]) for i in some)), -2)
        for r, i in enumerate(some):
            a[r, : len(items[i])] = [of(w) for w in items[i]]
            b[r, : len(texts[i])] = [of(w) for w in texts[i]]
        before, ramp = np.zeros((len(some), b.shape[1] + 1), np.int64), -GAP * np.arange(b.shape[1] + 1)
        top, where = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for i in range(a.shape[1]):
            now = np.maximum(before + GAP, 0)
            now[:, 1:] = np.maximum(now[:, 1:], before[:, :-1] + np.where(a[:, i, None] == b, MATCH, MISMATCH))
            now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps in the item: the best cell to the left, less a gap for each step
            high = now.max(axis=1)
            better = high > top
            where[better] = now.argmax(axis=1)[better]
            top = np.maximum(top, high)
            before = now
        best[some], ends[some] = top, where
    return best, ends


def leaks(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, min_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds a copy of: id, item_id, score (0 to 1), start (the first word of the
    passage that was aligned) and end (the word after the alignment).

    A copy is a passage whose best local alignment with the item (match 2, mismatch -1, gap -1) scores `least` of the item's own score or
    more and that holds one of its n-grams, however frequent. Null and empty texts and items hold nothing; a null id stays null; rows with equal ids are one document; the best passage is
    given, the first of equals; items of fewer than min_words words (by default n, as a shorter one
    has no n-gram) are no evidence and are not sought; empty tables give no rows; other columns are not read.
    """
    min_words = n if min_words is None else min_words
    texts = keyed_texts(docs, id_col, text_col)
    tests = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    seeds = stored(seeds_of(tests, n).where(F.col("size") >= min_words), "seeds")
    few = seeds.count() <= MAX_SENT and (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= MAX_BYTES
    found = passages(texts, seeds, n, few)
    whole = tests.join(seeds.select(F.col("item").alias("of")).distinct(), F.col("id").eqNullSafe(F.col("of")), "left_semi").select(F.col("id").alias("item"), "text").distinct()
    schema = "id long, item long, score double, start long, end long"

    def aligned(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (id, item, first, passage words, item words). Where too few of the item's words occur for the score, none is computed."""
        inside = [set(r[3]) for r in rows]
        rows = [r for r, own in zip(rows, inside, strict=True) if sum(w in own for w in r[4]) >= least * len(r[4])]
        best, ends = align([r[4] for r in rows], [r[3] for r in rows])
        scores = best / np.array([MATCH * len(r[4]) for r in rows])
        out = [(r[0], r[1], s, r[2], r[2] + e) for r, s, e in zip(rows, scores.tolist(), ends.tolist(), strict=True) if s >= least]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64() if i == 2 else pa.int64()) for i in range(5)], ["id", "item", "score", "start", "end"])

    if few:
        own: dict = {}
        for item, text in whole.collect():
            if len(words_of(text)) >= min_words:
                own.setdefault(item, []).append(words_of(text))
        sent = texts.sparkSession.sparkContext.broadcast(own)

        def score(batches) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                rows = []
                for key, item, first, words in zip(*(batch.column(c) for c in ("id", "item", "first", "words")), strict=True):
                    rows += [(key.as_py(), item.as_py(), first.as_py(), words.as_py(), x) for x in own[item.as_py()]]
                if rows:
                    yield aligned(rows)

        scored = found.mapInArrow(score, schema)
    else:
        kept = found.join(whole.select(F.col("item").alias("of"), F.col("text").alias("item_text")), F.col("item").eqNullSafe(F.col("of")))

        def score(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(key.as_py(), item.as_py(), first.as_py(), words.as_py(), words_of(text.as_py())) for key, item, first, words, text in zip(*(batch.column(i) for i in range(5)), strict=True)]
                rows = [r for r in rows if len(r[4]) >= min_words]
                if rows:
                    yield aligned(rows)

        scored = kept.select("id", "item", "first", "words", "item_text").mapInArrow(score, schema)
    best = scored.groupBy("id", "item").agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.score", "b.start", "b.end")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that hold a copy of a benchmark item (see leaks); columns as they were, whatever their names. Unlike texts that
    share an id (or have none) are told apart by a hash."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    key = F.xxhash64(F.col(f"own.`{id_col}`"), F.col(f"own.`{text_col}`"))
    bad = leaks(own.select(key.alias("key"), F.col(f"own.`{text_col}`").alias("text")), items, id_col="key", text_col="text", **how).select("key").distinct()
    kept = own.withColumn("key", key).join(bad, "key", "left_anti")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])
