"""A training corpus from documents: language, repeated lines, near copies, benchmark copies, packing.

Each stage reads only what its predecessor kept. All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language, line_dedup, packing, simhash
from tickloom.llm.shared import deleted, scratch, shared_folder, stored


#: Whole texts that go to Python together in a stage.
ROWS = 250


def bounded(spark: SparkSession) -> int | str:
    """Texts go to Python ROWS at a time at most: every stage's workers hold whole texts. The session's own setting, for `run` to put back: a
    stage is lazy, so its rows are made when its caller writes them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(key)
    spark.conf.set(key, str(min(int(now), ROWS) if int(now) > 0 else ROWS))
    return now


def apart(docs: DataFrame) -> DataFrame:
    """The documents' text, and their other columns in one struct, `own`, so that no name of theirs can clash with a stage's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"), "text")


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text" if c == "text" else f"own.`{c}`").alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language: those whose text has a letter, as the operator rejects the others. A document without a language of its own takes
    the predicted one.

    The model learns from the labelled rows of docs; if there are none, no language is known, and documents with a letter stay as they are. A
    null text goes. Empty in, empty out.
    """
    bounded(spark)
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(apart(docs), model, pred_col="predicted").where(F.col("predicted") != language.UND)
    lang = F.coalesce(F.col("own.`lang`"), F.col("predicted"))
    return found.select(*[(F.col("text") if c == "text" else lang if c == "lang" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that match an earlier line; n_chars follows a text that changed. Null texts stay as they are."""
    bounded(spark)
    cut = line_dedup.dedup_lines(apart(docs).withColumn("doc_id", F.col("own.doc_id")))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("own.n_chars"))}
    return cut.select(*[(new[c] if c in new else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (a null id last), of unlike texts with one id the one with
    the smallest hash of its text, and of equal rows any one. Unlike documents that share an id, or have none, are told apart."""
    bounded(spark)
    prints = stored(simhash.grouped(docs), "groups")  # (id, text_hash, root): a row for each document
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash"))
    keep = stored(prints.groupBy("root").agg(first.alias("k"), F.count("*").alias("m")).select(F.col("root"), F.col("k.id").alias("id"), F.col("k.text_hash").alias("text_hash"), "m"), "kept")
    # of equal rows one stays: those that are kept more than once are few, and are counted by their key
    again = stored(prints.join(keep.where("m > 1").drop("m", "root"), prints["id"].eqNullSafe(keep["id"]) & (prints["text_hash"] == keep["text_hash"]), "left_semi").groupBy("id", "text_hash").count().where("count > 1"), "again")
    rows = apart(docs).withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    key = lambda df: F.col("own.doc_id").cast("long").eqNullSafe(df["id"]) & (F.col("h") == df["text_hash"])
    kept = rows.join(keep.select("id", "text_hash"), key(keep), "left_semi")
    if again.isEmpty():
        return together(kept, docs.columns)
    single = kept.join(again, key(again), "left_anti")
    double = kept.join(again, key(again), "left_semi").groupBy(F.col("own.doc_id").alias("id"), "h").agg(F.first(F.struct("own", "text")).alias("x"))
    return together(single.select("own", "text").unionByName(double.select("x.own", "x.text")), docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    bounded(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document."""
    bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: SQL cannot express the stages; tests/llm checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's rows written to the shared folder and read again. What a stage stores for itself goes when
    its rows are written, and its rows go when the next stage's are."""
    docs, before, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, bounded(spark)
    try:
        for name, stage in STAGES:
            path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                deleted(spark, before)
            before = path
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    return docs
