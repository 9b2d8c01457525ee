"""Words that collide under every polynomial modulo 2**64 are told apart."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import line_dedup, packing, shared, token_counts, wavelet
from tickloom.llm.pretoken import Cutter


def pair(letters):
    """A Thue-Morse word and its complement."""
    bits = np.array([bin(i).count("1") % 2 for i in range(letters)])
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_quick_hashes_collide_and_drawn_ones_do_not():
    for letters in (64, 1024, 2048, 4096):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in pair(letters))
        data, start = np.concatenate([a, b]), np.array([0, letters])
        drawn = shared.drawn_hashes(data, start, start + letters)
        assert drawn[0] != drawn[1]
        assert not shared.same_spans(data, start[:1], start[1:], np.array([letters]))[0]
    assert len(set(shared.span_hashes(data, start, start + letters).tolist())) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_ids_and_counts_equal_the_library(name, letters):
    path = public_tokenizers.path(name)
    a, b = pair(letters)
    texts = [f"x {a} {b}", f"x {b}", f"{b} {a} x {b}", a]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    own = Cutter(path)
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_many(texts)] == want
    assert own.count_many(texts) == list(map(len, want))


def test_spans_compare_by_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    size = rng.integers(0, 70, 3000)
    a, b = rng.integers(0, 3900, 3000), rng.integers(0, 3900, 3000)
    b[:500] = a[:500]
    raw = data.tobytes()
    assert shared.same_spans(data, a, b, size).tolist() == [raw[x : x + n] == raw[y : y + n] for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)]


def test_operators(spark):
    import zlib

    a, b = pair(2048)
    docs = spark.createDataFrame([(1, f"x {a} {b}"), (2, f"x {b}"), (3, a), (4, b)], "doc_id long, text string").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    byte, word = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {i: Tokenizer.from_file(byte).encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, byte).collect()} == {i: len(x) for i, x in ids.items()}
    path = f"{shared.shared_folder(spark)}/shards-collisions-{np.random.default_rng().integers(2**62)}"
    wavelet.write_shards(docs, path, byte)
    assert {r.doc_id: r.ids_crc32 for r in wavelet.documents(wavelet.read_shards(spark, path)).collect()} == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in ids.items()}
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, word).collect()}
    assert packed == {i: zlib.crc32(np.array([*Tokenizer.from_file(word).encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts.items()}
    kept = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs.where("doc_id > 2")).collect()}
    assert kept == {3: 0, 4: 0}
