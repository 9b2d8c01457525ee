"""Token counts without ids: piece counts of distinct pre-tokens times their frequencies in each document.

Every task keeps one table of distinct pre-tokens and their piece counts (bounded, see pretoken.Pieces); each document's pre-token
frequencies are joined to it and summed. The join stays inside the task: sent through a shuffle, the pairs of document and
pre-token are larger than the texts themselves, while the table is rebuilt from the tokenizer's vocabulary anywhere.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.pretoken import cutter
from tickloom.llm.shared import keyed_texts, slices


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; equal rows each give a row; other columns are not read;
    an empty table gives no rows. Special strings inside a text count as the tokenizer's default has them (one token each).
    """

    def count(batches):
        for batch in slices(batches):
            table = cutter(tokenizer_path)
            texts = batch.column(1).to_pylist()
            tokens = table.count_many(texts)
            sizes = [len(x.encode("utf-8")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = keyed_texts(docs, id_col, text_col).mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
