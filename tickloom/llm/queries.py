"""The operators' registered queries: each applies one operator with its production parameters to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, html_text, language, line_dedup, packing, passages, phrases, repetition, simhash, token_counts, topk, wavelet, whitening
from tickloom.llm.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.documents(wavelet.read_shards(spark, path))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out")
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_wavelet_shards, op3_repeated_passages, op4_packing, op5_language, op6_simhash, op7_line_dedup, op8_decontamination, op9_top_k, op10_main_text, op11_collocations, op12_repetition, op13_whitening)
    return {f.__name__: f for f in own}


def _repetition_sql() -> str:
    """The measures and rules of repetition.quality."""
    lengths = [repetition.WINDOW, *repetition.GRAM_LIMITS]
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, n))])  # noqa: E731  null at the text's end
    white, line = r"[^\x20\x09-\x0D]", "string_split(t, chr(10))"
    columns = ", ".join(f"CAST(coalesce(dup_{n}_chars, 0) AS BIGINT) AS dup_{n}_chars" for n in repetition.GRAM_LIMITS)
    rules = " OR ".join([f"100 * n_symbols > {repetition.SYMBOL_LIMIT} * n_words", f"100 * dup_line_chars > {repetition.LINE_LIMIT} * word_chars", *(f"100 * dup_{n}_chars > {limit} * word_chars" for n, limit in repetition.GRAM_LIMITS.items())])
    failed = f"(n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{white}+') AS ws FROM d)),
        g AS (SELECT r, i, w, {", ".join(f"{gram(n)} AS g{n}" for n in lengths)} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        m AS (SELECT r, i, w, {", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS d{n}" for n in lengths)} FROM g),
        c AS (SELECT r, length(w) AS size, {", ".join(f"max(d{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)} FROM m),
        s AS (SELECT r, count(*) AS n_words, sum(size) AS word_chars, count(*) FILTER (c{repetition.WINDOW}) AS n_repeat_words,
                     {", ".join(f"sum(size) FILTER (c{n}) AS dup_{n}_chars" for n in repetition.GRAM_LIMITS)} FROM c GROUP BY r),
        l AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars FROM
              (SELECT r, x, row_number() OVER (PARTITION BY r, x ORDER BY i) AS k FROM (SELECT r, unnest({line}) AS x, generate_subscripts({line}, 1) AS i FROM d))
              WHERE k > 1 AND regexp_matches(x, '{white}') GROUP BY r),
        f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {columns}
              FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r))
        SELECT *, {failed} AS base_failed, NOT {failed} AND NOT ({rules}) AS kept FROM f
    """


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator; the others are tested against brute force in tests/llm."""
    return {
        "op9_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
        """,
        "op11_collocations": r"""
            WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
                       (SELECT coalesce(lang, 'und') AS lang,
                               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
            w AS (SELECT piece, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
            g AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
            f AS (SELECT lang, m, phrase, count(*) AS f FROM
                  (SELECT lang, 1 AS m, w AS phrase FROM g UNION ALL SELECT lang, 2, w || ' ' || w2 FROM g WHERE w2 IS NOT NULL
                   UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL
                   UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM g WHERE w4 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30),
            c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
            cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
                     FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
                     JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
            best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            subs AS (SELECT lang, a, w, n, unnest(range(1, m - n + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS n FROM c WHERE m > 2)),
            longer AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS f FROM subs GROUP BY ALL),
            kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 80 * a),
            n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
            SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
            FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
        """,
        "op12_repetition": _repetition_sql(),
    }
