"""Language ID by words first, with backoff to character n-grams.

A model holds, for each language, log frequencies of its known words, and of the character n-grams of words (with marks for the
word's ends). A known word adds its log frequency in each language. An unseen word is read left to right: at each place the
longest known n-gram counts, from `max_n` characters down to one; the word adds the mean of its n-grams' log frequencies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import held, tidy

UND = "und"
#: Words that are summed at a time.
STEP = 4096
#: A word: a run of letters and of numbers that are no digits, with apostrophes inside.
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: The same for Spark's patterns.
WORD_JVM = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*"


class _Rows(dict):
    """word -> row of a table of scores: the model's words first, then unseen words as they come, `cache` of them at most."""

    def __init__(self, model: LanguageModel, cache: int):
        super().__init__(model.words)
        self.model, self.known = model, len(self)
        self.table = np.zeros((self.known + cache, len(model.langs)))
        self.table[: self.known] = model.word_table

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.table[row] = self.model.backoff(word)
        return row


class LanguageModel:
    """Languages in order, and the rows of words and n-grams in tables of log frequencies, a column for each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], max_n: int, cache: int = 100_000):
        self.langs, self.max_n, self.cache = langs, max_n, cache
        self.words, self.grams = {w: i for i, w in enumerate(words)}, {g: i for i, g in enumerate(grams)}
        self.word_table, self.gram_table = (np.array(list(x.values())).reshape(len(x), len(langs)) for x in (words, grams))
        self.rows: _Rows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-grams that the word is made of, from its start; 0 for each language if none is known."""
        marked, found, at, get = f"^{word}$", [], 0, self.grams.get
        while at < len(marked):
            for n in range(min(self.max_n, len(marked) - at), 0, -1):
                gram = get(marked[at : at + n])
                if gram is not None:
                    found.append(gram)
                    at += n
                    break
            else:
                at += 1
        return self.gram_table[found].mean(axis=0) if found else np.zeros(len(self.langs))

    def score(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language, by the word table or by backoff."""
        if self.rows is None:
            self.rows = _Rows(self, self.cache)
        return self.rows.table[self.rows[word]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior from 0 to 1); (und, 0) without a letter. Ties go to the first language."""
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UND, 0.0
        if self.rows is None:
            self.rows = _Rows(self, self.cache)
        total = np.zeros(len(self.langs))
        for at in range(0, len(words), STEP):
            some = words[at : at + STEP]
            if len(self.rows) + len(some) > len(self.rows.table):  # no row may be given away while it is summed
                self.rows = _Rows(self, self.cache)
            total += self.rows.table[np.fromiter(map(self.rows.__getitem__, some), np.int64, len(some))].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _sample(docs: DataFrame, max_docs: int, max_languages: int) -> DataFrame:
    """At most about max_docs labelled documents of each language, by a hash of the id: (id, text, lang). Only the counts of the languages,
    max_languages at most, are sent to the tasks; texts that are not chosen go nowhere."""
    counts = docs.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more languages than max_languages ({max_languages})")
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, max_docs / n)) for x, n in counts], "lang string, share double")
    spread = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(shares), "lang").where(spread < F.col("share")).select("id", "text", "lang")


def fit(docs: DataFrame, max_docs: int = 2000, max_words: int = 30_000, max_grams: int = 30_000, max_n: int = 5, max_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of the labelled rows: about max_docs documents of each language, chosen by a hash of their id.

    The model is bounded too: the max_words commonest words and max_grams commonest n-grams of each language (ties by text), so it
    may be collected and sent to every task. Rows with a null text, a null language or the language und are not learned from; an empty table
    gives a model without languages, whose predictions are all und.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and lang <> 'und'")
    words = _sample(rows, max_docs, max_languages).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_JVM), F.lit(0))).alias("key")).groupBy("lang", "key").count()
    words = words.persist()
    try:
        marked = F.concat(F.lit("^"), "key", F.lit("$"))
        grams = words.select("lang", "count", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
        grams = grams.where(F.length("w") >= F.col("n")).select("lang", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring("w", i, F.col("n")))).alias("key"))
        grams = grams.groupBy("lang", "key").agg(F.sum("count").alias("count"))

        def table(df: DataFrame, most: int) -> dict[str, dict[str, int]]:
            from pyspark.sql import Window

            order = Window.partitionBy("lang").orderBy(F.desc("count"), "key")
            kept = df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("lang", "key", "count")
            out: dict[str, dict[str, int]] = {}
            for lang, key, n in kept.toPandas().itertuples(index=False, name=None):
                out.setdefault(lang, {})[key] = n
            return out

        by_word, by_gram = table(words, max_words), table(grams, max_grams)
    finally:
        words.unpersist()
    langs = sorted(by_word)
    return LanguageModel(langs, _logs(by_word, langs), _logs(by_gram, langs), max_n)


def _logs(counts: dict[str, dict[str, int]], langs: list[str]) -> dict[str, np.ndarray]:
    """Add-one-half log frequencies; a key that a language lacks has the frequency of half a count there."""
    keys = sorted({k for c in counts.values() for k in c})
    totals = [sum(counts.get(x, {}).values()) + 0.5 * (len(keys) + 1) for x in langs]
    return {k: np.array([math.log((counts.get(x, {}).get(k, 0) + 0.5) / n) for x, n in zip(langs, totals, strict=True)]) for k in keys}


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior (0 to 1) of every whole text, in two more columns.

    und and 0 for a null text or one without a letter. Only the text is read for a prediction. Equal texts get equal predictions; an empty table stays empty;
    columns of docs named like the two new ones are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by fit: max_words and max_grams a language

    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held()
        own = sent.value
        for column in texts:
            yield pd.DataFrame([own.predict(x) for x in column], columns=["lang", "score"])
        own.rows = None  # a waiting worker keeps no table of unseen words
        tidy()

    labelled = F.pandas_udf(label, "lang string, score double").asNondeterministic()  # else a filter on the result would label every text twice
    kept = docs.drop(pred_col, score_col)
    # the documents' own columns travel in one struct, so no name of theirs can clash
    found = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("own"), labelled(F.col(f"`{text_col}`").cast("string")).alias("label"))
    return found.select(*[F.col(f"own.`{c}`").alias(c) for c in kept.columns], F.col("label.lang").alias(pred_col), F.col("label.score").alias(score_col))
