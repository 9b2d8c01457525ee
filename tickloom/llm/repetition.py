"""Quality rules by repetition: the characters inside a text's repeated word n-grams and lines.

The words of many texts are numbered together; rolling hashes over these numbers, one n-gram length after the other, find the n-grams that a
text repeats, and every hit is compared word by word with the first of its kind. A length only looks where the length before it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import mixed, small_batches, tidy

#: Bytes of texts that are worked on together; a longer text is worked on alone.
BLOCK = 2_000_000
#: Words of the base rule's windows.
WINDOW = 3
#: Rules: of the characters in words, the most percent that may lie in repeated n-grams of a length, the first of each included.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for lines that equal an earlier one, and symbols for each 100 words.
LINE_LIMIT, SYMBOL_LIMIT = 20, 10
#: The base rule: words that a text needs, and the most percent of them that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

# White space and symbols.
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
IN_WORD = np.ones(256, bool)
IN_WORD[[ord(c) for c in WHITE]] = False
STEP = np.uint64(0xD6E8FEB86659FD93)

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}_chars" for n in GRAM_LIMITS)]


def repeated(words: np.ndarray, doc: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the places at which an n-gram starts that its document holds twice or more."""
    value = mixed((np.arange(words.max() + 1 if len(words) else 0).astype(np.uint64) + np.uint64(1)) * STEP)[words]
    at, h = np.arange(len(words)), mixed(doc.astype(np.uint64) * STEP) + value
    for n in range(2, max(lengths) + 1):
        keep = at + n - 1 < len(words)
        at, h = at[keep], h[keep]
        keep = doc[at] == doc[at + n - 1]
        at, h = at[keep], h[keep] * STEP + value[at[keep] + n - 1]
        code, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = at[::-1]
        like = first[code]
        same = doc[like] == doc[at]
        for k in range(n):
            same &= words[like + k] == words[at + k]
        if not same.all():  # two n-grams of one hash: number the n-grams by their words
            code = pd.factorize(doc[at])[0].astype(np.int64)
            for k in range(n):
                code = pd.factorize(code * (int(words.max()) + 1) + words[at + k])[0].astype(np.int64)
        keep = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
        at, h = at[keep], h[keep]
        if n in lengths:
            yield n, at


def line_repeats(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of their words."""
    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            chars += len(line) - sum(map(line.count, WHITE))
        elif line.strip(WHITE):
            seen.add(line)
    return lines, chars


def measures(texts: list[str]) -> np.ndarray:
    """FIELDS of each text, a row each."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(x) + 1 for x in raw])
    doc = np.searchsorted(ends, start, side="right")
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    size = points[end] - points[start]
    words = pd.factorize(np.array(joined.split(), dtype=object))[0].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    many, total = len(texts), lambda at, weights=None: np.bincount(doc[at], weights, len(texts)).astype(np.int64)
    out = np.zeros((many, len(FIELDS)), np.int64)
    everything = np.arange(len(doc))
    out[:, 0], out[:, 1] = total(everything), total(everything, size)
    for i, text in enumerate(texts):
        out[i, 2] = sum(map(text.count, SYMBOLS))
        if "\n" in text:
            out[i, 3], out[i, 5] = line_repeats(text)
    for n, at in repeated(words, doc, [WINDOW, *GRAM_LIMITS]):
        if len(at):
            change = np.zeros(len(words) + 1, np.int64)
            change[at] += 1
            change[at + n] -= 1
            covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            if n == WINDOW:
                out[:, 4] = total(covered)
            else:
                out[:, FIELDS.index(f"dup_{n}_chars")] = total(covered, size[covered])
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, FIELDS (long), base_failed and kept.

    A null or empty text has no words, so it fails. Equal rows each give a row; a null id stays null; other columns are not read; an empty
    table gives no rows. Texts are measured whole, whatever their length.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1).to_pylist(), []
            held, size = [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size > BLOCK:
                    done.append(measures(held))
                    held, size = [], 0
            if held:
                done.append(measures(held))
            if done:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(column) for column in np.concatenate(done).T)], ["id", *FIELDS])
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        out = rows.mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in FIELDS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    bad = (100 * F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words")) | (100 * F.col("dup_line_chars") > LINE_LIMIT * F.col("word_chars"))
    for n, limit in GRAM_LIMITS.items():
        bad |= 100 * F.col(f"dup_{n}_chars") > limit * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad).withColumnRenamed("id", id_col)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes the rules, with all their columns. A row is met again by its id and text, so unlike texts of one id
    are judged apart; equal rows stay or go together; a null text goes."""
    good = quality(docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct(), "h", "t").where("kept").select("h")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(F.col(text_col)).alias("h"))
    return own.join(good.distinct(), "h", "left_semi").select("own.*")
