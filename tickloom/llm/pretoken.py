"""Pre-tokens of the public tokenizers, and tables that keep the pieces of each distinct one.

A text is cut into the tokenizer's pre-tokens; merges never cross them, so a pre-token's pieces are looked up once and reused.
Texts of common characters are cut by a pattern for `re` that equals the tokenizer's on those characters; any other text is cut
by the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter, mul

import numpy as np

from tickloom.llm.shared import held, same_spans, span_hashes

#: Ranges of common characters. Inside them, letters and numbers are those below, white space is space, tab, line feed, vertical tab,
#: form feed, carriage return and no-break space, and normalisation form C changes nothing.
COMMON = ((0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))


def outside(kept: list[str]) -> re.Pattern:
    """A pattern for any character but those kept."""
    return re.compile("[^" + "".join(re.escape(c) for c in kept) + "]")


CHARACTERS = [chr(x) for a, b in COMMON for x in range(a, b + 1)]
#: A text (between special strings) that holds such a character is cut by the library's own pre-tokenizer. Where texts are lower-cased first,
#: a capital whose small letter is not common counts as uncommon, too.
UNCOMMON = outside(CHARACTERS)
UNCOMMON_LOWERED = outside([c for c in CHARACTERS if set(c.lower()) <= set(CHARACTERS)])
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"

# The two tokenizers' pre-token patterns, over the common characters.
BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")

#: The other white space among the common characters.
OTHER_SPACE = "\t\n\v\f\r\u00a0"


def plain_spaces(text: str) -> bool:
    """Whether every space stands between two characters that are not white space."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text:
        return False
    return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE)


#: Texts longer than this many characters are cut match by match instead of into one list.
LONG = 2_000_000
#: Characters whose distinct chunks are looked up together; a longer text is cut alone.
BLOCK = 1_500_000


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merger(path: str, tokenizer):
    """A faster encoder of single pre-tokens for the byte-pair tokenizer in `path`: the pieces of a pre-token's bytes, or None.

    It always merges the adjacent pair whose bytes are the token of the smallest id. That gives the library's pieces if ids rise in the order of
    the merges, each token comes of one merge, and the library encodes each token's own bytes as that token: inside a span that becomes
    a token, all merges of smaller ids are done first, and these lead to the token's one pair. All three are checked here.
    """
    try:
        from tiktoken import _tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "unk_token", "byte_fallback")):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    byte_of = {c: b for b, c in byte_alphabet().items()}
    made, tokenize = [vocab[a + b] for a, b in merges], tokenizer.model.tokenize
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or len(vocab) != len(merges) + 256 or not all(c in byte_of for t in vocab for c in t):
        return None
    if any([x.id for x in tokenize(t)] != [i] for t, i in vocab.items()) or min(made, default=256) < max(vocab[c] for c in byte_of):
        return None
    return _tiktoken.CoreBPE({bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, {}, r"\S+").encode_single_piece


class Pieces(dict):
    """pre-token -> its piece ids as little-endian bytes. Entries are kept in two generations of `limit` at most."""

    def __init__(self, tokenizer, limit: int, merge=None):
        super().__init__()
        self.tokenizer, self.limit, self.old, self.merge = tokenizer, limit, {}, merge
        self.tokenize = tokenizer.model.tokenize
        self.table = byte_alphabet()

    def kept(self, ids: list[int]) -> object:
        return array("H", ids).tobytes()

    def of(self, mapped: str) -> object:
        """The value of a pre-token in the byte-level alphabet."""
        return self.kept([t.id for t in self.tokenize(mapped)])

    def make(self, key: str) -> object:
        data = key.encode("utf-8")
        return self.kept(self.merge(data)) if self.merge else self.of(data.decode("latin-1").translate(self.table))

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Counts(Pieces):
    """pre-token -> number of its pieces."""

    def kept(self, ids: list[int]) -> int:
        return len(ids)


class Chunks(Pieces):
    """A run without spaces, in UTF-8 -> the ids of a space and the run. A space between two other characters always starts a pre-token."""

    def __init__(self, pieces: Pieces, pattern: re.Pattern, lead: str):
        super().__init__(pieces.tokenizer, pieces.limit)
        self.pieces, self.pattern, self.lead = pieces, pattern, lead

    def make(self, key: bytes) -> object:
        text = key.decode("utf-8")
        if text.isalpha():  # one pre-token, kept here alone
            return self.pieces.make(self.lead + text)
        return self.sum(map(self.pieces.__getitem__, self.pattern.findall(self.lead + text)))

    def sum(self, values: Iterable) -> object:
        return b"".join(values)


class ChunkCounts(Chunks):
    """A run without spaces, in UTF-8 -> the number of pieces of a space and the run."""

    def sum(self, values: Iterable) -> object:
        return sum(values)


class Cutter:
    """Cuts texts into pre-tokens and encodes or counts them, as the tokenizer in `path` does without added special tokens."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.normalizer is not None
        self.pattern = WORD_PATTERN if self.words else BYTE_PATTERN
        self.uncommon = UNCOMMON_LOWERED if self.words else UNCOMMON
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        if max(self.special.values(), default=0) >= 2**16 or self.tokenizer.get_vocab_size() > 2**16:
            raise ValueError("ids of more than 16 bits")
        merge = merger(path, self.tokenizer)
        self.pieces, self.counts = Pieces(self.tokenizer, limit, merge), Counts(self.tokenizer, limit, merge)
        self.mapped, self.mapped_counts = Pieces(self.tokenizer, limit), Counts(self.tokenizer, limit)
        self.mapped.make, self.mapped_counts.make = self.mapped.of, self.mapped_counts.of
        lead = "" if self.words else " "
        self.chunks, self.chunk_counts = Chunks(self.pieces, self.pattern, lead), ChunkCounts(self.counts, self.pattern, lead)

    def clear(self) -> None:
        """Empty the tables."""
        for x in (self.pieces, self.counts, self.mapped, self.mapped_counts, self.chunks, self.chunk_counts):
            x.clear()
            x.old.clear()

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special strings, each with the id of the special string after it."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def library_pretokens(self, segment: str) -> list[str]:
        if self.words:
            segment = self.tokenizer.normalizer.normalize_str(segment)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]

    def pretokens(self, segment: str) -> Iterable[str]:
        if self.words:
            segment = segment.lower()
        return self.pattern.findall(segment) if len(segment) <= LONG else map(itemgetter(0), self.pattern.finditer(segment))

    def count(self, text: str) -> int:
        """Tokens of a text: its distinct pre-tokens' piece counts, each times its frequency."""
        total = 0
        for segment, special in self.segments(text):
            common = self.uncommon.search(segment) is None
            found = Counter(self.pretokens(segment) if common else self.library_pretokens(segment))
            counts = self.counts if common else self.mapped_counts
            total += sum(map(mul, map(counts.__getitem__, found), found.values())) + (special is not None)
        return total

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 16-bit integers."""
        out = []
        for segment, special in self.segments(text):
            if self.uncommon.search(segment) is not None:
                out.append(b"".join(map(self.mapped.__getitem__, self.library_pretokens(segment))))
            elif plain_spaces(segment):
                first, *rest = (segment.lower() if self.words else segment).split(" ")
                out.append(b"".join(chain(map(self.pieces.__getitem__, self.pattern.findall(first)), map(self.chunks.__getitem__, map(str.encode, rest)))))
            else:
                out.append(b"".join(map(self.pieces.__getitem__, self.pretokens(segment))))
            if special is not None:
                out.append(special.to_bytes(2, "little"))
        return b"".join(out)


    def easy(self, text: str) -> bool:
        """Whether a text is cut into pre-tokens at its spaces first."""
        return 0 < len(text) <= BLOCK and (self.split is None or self.split.search(text) is None) and self.uncommon.search(text) is None and plain_spaces(text)

    def _chunked(self, texts: list[str], counts: bool) -> tuple[list, np.ndarray, np.ndarray]:
        """Of easy texts: the values of their distinct chunks, each chunk's place among these, and the chunk at which each text starts."""
        raw = "\0".join(t.lower() if self.words else t for t in texts).encode("utf-8")  # no common character is a zero
        data = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero((data & 0xDF) == 0)  # spaces and zeros
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        h = span_hashes(data, start, end)
        at = np.concatenate([[0], np.flatnonzero(data[gaps] == 0) + 1])
        h[at] ^= np.uint64(0x5851F42D4C957F2D)  # a text's first chunk follows no space
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        first = np.zeros(len(h), bool)
        first[at] = True
        chunks, pieces = (self.chunk_counts, self.counts) if counts else (self.chunks, self.pieces)

        def value(a: int, b: int, f: bool) -> object:
            return chunks.sum(map(pieces.__getitem__, self.pattern.findall(raw[a:b].decode("utf-8")))) if f else chunks[raw[a:b]]

        values = [value(*x) for x in zip(start[index].tolist(), end[index].tolist(), first[index].tolist(), strict=True)]
        # a hash only proposes: a chunk that differs from the one it is taken for gets a value of its own
        like, size = index[inverse], end - start
        same = (size == size[like]) & (first == first[like])
        same[same] = same_spans(data, start[same], start[like[same]], size[same])
        for i in np.flatnonzero(~same).tolist():
            inverse[i] = len(values)
            values.append(value(int(start[i]), int(end[i]), bool(first[i])))
        return values, inverse, at

    def _many(self, texts: list[str], counts: bool) -> list:
        out, easy, held = [None] * len(texts), [], 0

        def flush() -> None:
            nonlocal easy, held
            values, inverse, at = self._chunked([texts[i] for i in easy], counts)
            sizes = np.array(values, np.int64) if counts else np.fromiter(map(len, values), np.int64, len(values)) // 2
            every = sizes[inverse]
            totals = np.add.reduceat(every, at)
            if counts:
                for i, n in zip(easy, totals.tolist(), strict=True):
                    out[i] = n
            else:
                flat, begin = np.frombuffer(b"".join(values), "<u2"), np.cumsum(sizes) - sizes
                ids = flat.take(np.repeat(begin[inverse] - (np.cumsum(every) - every), every) + np.arange(every.sum())).tobytes()
                ends = (2 * np.cumsum(totals)).tolist()
                for i, a, b in zip(easy, [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[a:b]
            easy, held = [], 0

        for i, text in enumerate(texts):
            if not self.easy(text):
                out[i] = self.count(text) if counts else self.encode(text)
                continue
            easy.append(i)
            held += len(text)
            if held >= BLOCK:
                flush()
        if easy:
            flush()
        return out

    def count_many(self, texts: list[str]) -> list[int]:
        """count of each text. The distinct chunks of about BLOCK characters are counted once and joined to every text's chunks."""
        return self._many(texts, True)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode of each text."""
        return self._many(texts, False)


def cutter(path: str, limit: int = 400_000) -> Cutter:
    """One Cutter for each tokenizer file and Python worker; `limit` bounds each of its tables."""
    return held((path, limit), lambda: Cutter(path, limit))
