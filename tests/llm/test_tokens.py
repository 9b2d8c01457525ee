"""Counting, encoding, shards and packing against the tokenizers library."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import packing, pretoken, queries, token_counts, wavelet
from tickloom.llm.pretoken import Cutter

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", " a", "a ", "a\n\n b  c", "<|endoftext|>x <|endoftext|>", "日本語 テスト 123", "İstanbul x", "don't we'll 'S it's", "a b   c", "é x", "\x1c a \x1d", "²³ x¼ 12", "tab\tx\t\ty\r\n z", "<|startoftext|>A<|endoftext|>", "%'s '' ''s", "ß ẞ ſ", "x" * 5000, " " * 50 + "x", "a\x85b", "a\n b", "a \nb", "﻿a", "🙂 ok 👩‍👩‍👧", "K Å", "a\xa0b \xa0 c"]
SF = "/root/testdata/sf0.001"
SCHEMA = "extra string, doc_id long, text string, id long"
ROWS = [("x", 3, "the same text", 0), ("y", 3, "the same text", 1), (None, None, "no id", 2), ("z", 4, None, 3), ("z", 5, "", 4), (None, 6, "long words " * 20_000, 5)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cutter_equals_library_on_odd_texts(path):
    library, own = Tokenizer.from_file(path), Cutter(path, limit=50)
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u2").tolist() == ids
        assert own.count(text) == len(ids)


@cache
def both(path):
    return Tokenizer.from_file(path), Cutter(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stredlvm.,!09aéßñ|<>\xa0"), st.characters(codec="utf-8")), max_size=60))
def test_cutter_equals_library(path, text):
    library, own = both(path)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u2").tolist() == ids
    assert own.count(text) == len(ids)
    assert own.encode_many([text, "a b", text]) == [own.encode(x) for x in (text, "a b", text)]


def test_op1_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    library, rows = Tokenizer.from_file(BYTE), queries.op1_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.index)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_token_counts_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = sorted(token_counts.token_counts(docs, BYTE).collect(), key=str)
    assert len(out) == len(ROWS)
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in out} >= {(4, 0, 0), (5, 0, 0), (None, 5, 2)}
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_common_character_inside_a_word(path):
    library, own = both(path)
    texts = [f"ab{x}cd {x}x X{x}y {x}" for x in pretoken.CHARACTERS] + ["AZƏRBAYCAN Əli", "", " ", "a b", "one <|endoftext|> two"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_many(texts)] == want
    assert own.count_many(texts) == [own.count(t) for t in texts] == [len(x) for x in want]
    assert (own.pieces.merge is not None) == (path == BYTE)


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 9), max_size=1500), data=st.data())
def test_wavelet_matrix(ids, data):
    ids = np.array(ids, np.uint16)
    keys, lengths, matrix = wavelet.unpack_shard(wavelet.pack_shard([7, None], [1, 2], ids, 16))
    assert keys == [7, None] and lengths.tolist() == [1, 2]
    assert matrix.values().tolist() == ids.tolist()
    if len(ids):
        at = np.array(data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=5)), np.int64)
        assert matrix.access(at).tolist() == ids[at].tolist()
    for value in range(11):
        places = np.flatnonzero(ids == value).tolist()
        end = len(ids) // 2
        assert matrix.occurrences(value).tolist() == places
        assert matrix.rank(value, end) == sum(p < end for p in places)
        assert matrix.count(value, end) == sum(p >= end for p in places)
        assert matrix.select(value, 0) == (places[0] if places else -1)
        assert [matrix.select(value, k) for k in (-1, len(places) - 1, len(places))] == [-1, places[-1] if places else -1, -1]


def test_look_ups_inflate_only_what_they_touch():
    ids = np.random.default_rng(4).integers(0, 50_000, 1 << 20).astype(np.uint16)
    _, _, matrix = wavelet.unpack_shard(wavelet.pack_shard([1], [len(ids)], ids, 16))
    assert matrix.access(np.array([777_777])).tolist() == [ids[777_777]]
    places = np.flatnonzero(ids == 123)
    assert matrix.select(123, 5) == places[5] and matrix.rank(123, 500_000) == (places < 500_000).sum()
    assert sum(not x for p in matrix.planes for x in p.squeezed) < sum(len(p.pieces) for p in matrix.planes) / 2
    assert (matrix.values() == ids).all()


def test_op2_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    library, start, want = Tokenizer.from_file(BYTE), 0, set()
    for key, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.add((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in queries.op2_wavelet_shards(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_shards_edges_and_search(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    wavelet.write_shards(docs, f"{tmp_path}/a", BYTE, shard_tokens=100)
    shards = wavelet.read_shards(spark, f"{tmp_path}/a")
    out = wavelet.documents(shards).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 3, 3, 4, 5, 6]
    ends = [r.start + r.n_tokens for r in out]
    assert [r.start for r in out] == [0, *ends[:-1]]
    same = Tokenizer.from_file(BYTE).encode("the same text").ids
    hits = wavelet.occurrences(shards, same[1]).collect()
    assert sorted((r.doc_id, r.position) for r in hits if r.doc_id == 3) == [(3, 1), (3, 1)]
    wavelet.write_shards(docs.limit(0), f"{tmp_path}/b", BYTE)
    assert wavelet.documents(wavelet.read_shards(spark, f"{tmp_path}/b")).count() == 0


def test_best_fit_decreasing_against_search():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    window, offset = packing.best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for n, w, o in zip(lengths.tolist(), window.tolist(), offset.tolist(), strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert rooms[w] == min(fits) and o == 100 - rooms[w]
        else:
            assert w == len(rooms) and o == 0
            rooms.append(100)
        rooms[w] -= n


def check_packing(rows, texts):
    library = Tokenizer.from_file(WORD)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            piece = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return by_sequence


def test_op4_is_whole_and_tight(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op4_packing(spark, "/root/testdata/sf0.01").collect()
    sequences = check_packing(rows, texts)
    assert sum(r.length for r in rows) > 0.99 * 4096 * (len(sequences) - 1)


def test_packing_edges_and_sequences(spark):
    rows = [r for i, r in enumerate(ROWS) if i != 1]
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = packing.pack_documents(docs, WORD).persist()
    check_packing(packed.collect(), {r[1]: r[2] for r in rows})
    library = Tokenizer.from_file(WORD)
    want = {r[1]: [*library.encode(r[2] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.sequences(docs, packed, WORD).collect()}
    for r in packed.collect():
        assert got[r.sequence_id][r.offset : r.offset + r.length].tolist() == want[r.doc_id][r.start : r.start + r.length]
    assert all(len(x) == 4096 or len(x).bit_count() == 1 for x in got.values())
    twice = packing.pack_documents(spark.createDataFrame(ROWS[:2], SCHEMA), WORD)
    assert twice.count() == 2 and twice.agg(F.countDistinct("sequence_id", "offset")).first()[0] == 2
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0
