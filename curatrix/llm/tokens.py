"""Exact, vectorised encoding with the ``tokenizers`` library.

The word-level BPE vocabulary cuts a text by its own pattern into words (runs of
letters, single digits, runs of other signs) and never merges across them, so a
text's ids are those of its words in order.  Blocks of texts are cut into words
by operations on their bytes; words of up to 16 bytes are looked up in a hash
table of NumPy arrays whose keys are the bytes themselves, longer ones in a
dictionary, and the library's model is asked only for new ones.  Both are bounded.

Texts holding signs on whose class, case or composition Python and the library
might disagree are cut at white space, and the pieces with such signs go to the
library; texts with odd white space or the marker of special tokens go there
whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curatrix.llm import kernels as K
from curatrix.llm import workers

#: Signs that NFC leaves alone, whose lower case is one such sign, and on whose class all Unicode versions agree.
_LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ȹȻ-ȽȿɁ-ʯ"
_SIGN = f"!-~{_LETTER}‐-‧‰-⁞€"
_PLAIN = re.compile(f"[{_SIGN}]+")
_PLAIN_TEXT = re.compile(rf"[ \t\n\x0b\x0c\r{_SIGN}]*+")
_ASCII = bytes([9, 10, 11, 12, 13, *range(32, 127)])
#: The vocabulary's own pattern, for these signs.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = re.compile(_PATTERN.replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", _LETTER).replace(r"\p{N}", "0-9")).findall
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies spell bytes: those that are no printable sign follow from 256 on.
_SPELLED = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SAME)))}
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_LONG = 64
#: Longer texts are encoded in stretches of about so many bytes.
STRETCH = 2 << 20


def default_tokenizer() -> str:
    """Path of the public 49k word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    """Whether Python cuts and lowers ``text`` as the library does."""
    if text.isascii():
        return not text.encode().translate(None, _ASCII)
    return _PLAIN_TEXT.fullmatch(text) is not None


class _Known(dict):
    """Ids by key; ``learn`` gives those of a new key, which stay unless the key is very long."""

    def __init__(self, learn: Callable[[str], list[int]]) -> None:
        super().__init__()
        self._learn = learn
        self.older: dict[str, list[int]] = {}

    def __missing__(self, key: str) -> list[int]:
        ids = self.older.get(key)
        if ids is None:
            ids = self._learn(key)
        if len(key) <= _LONG:
            self[key] = ids
        return ids

    def bound(self, most: int) -> None:
        """Keep two halves: keys that recur come back from the older one."""
        if len(self) > most // 2:
            self.older = dict(self)
            self.clear()


#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 other signs (the signs of three bytes are set apart).
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix64(a ^ K.mix64(b + np.uint64(0x9E3779B97F4A7C15)))


class _Table:
    """Ids of words of up to 16 bytes: open addressing over the words' own bytes, in two numbers each."""

    def __init__(self) -> None:
        self.n = self._used = 0
        self._a, self._b, self._at, self.size = (np.zeros(1024, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.pool = np.zeros(4096, np.uint32)
        self._slot = np.zeros(4096, np.int32)  # entry's number from 1 on; 0 is free

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of the words, -1 for unknown ones."""
        last = len(self._slot) - 1
        at = (_hash(a, b) & np.uint64(last)).astype(np.int64)
        out = self._slot[at] - 1
        todo = np.flatnonzero((out >= 0) & ((self._a[out] != a) | (self._b[out] != b)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & last
            e = self._slot[at] - 1
            out[todo] = e
            miss = (e >= 0) & ((self._a[e] != a[todo]) | (self._b[e] != b[todo]))
            todo, at = todo[miss], at[miss]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add distinct words that are not there; ``ids`` holds ``size`` ids of each in turn."""
        m = self.n + len(a)
        if m > len(self._a):
            self._a, self._b, self._at, self.size = (np.concatenate((x[: self.n], np.zeros(2 * m - self.n, x.dtype))) for x in (self._a, self._b, self._at, self.size))
        if self._used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self._used], np.zeros(self._used + 2 * len(ids), np.uint32)))
        new = slice(self.n, m)
        self._a[new], self._b[new], self.size[new] = a, b, size
        self._at[new] = self._used + np.cumsum(size) - size
        self.pool[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        first, self.n = self.n, m
        if 3 * m > 2 * len(self._slot):
            self._slot = np.zeros(1 << (3 * m).bit_length(), np.int32)
            first = 0
        last = len(self._slot) - 1
        entry = np.arange(first, m, dtype=np.int32)
        at = (_hash(self._a[first:m], self._b[first:m]) & np.uint64(last)).astype(np.int64)
        while len(entry):
            free = self._slot[at] == 0
            self._slot[at[free]] = entry[free] + 1
            rest = self._slot[at] != entry + 1  # taken before, or by another of these
            entry, at = entry[rest], (at[rest] + 1) & last

    def ids(self, entry: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the entries in turn."""
        ends = np.cumsum(size)
        return self.pool[np.repeat(self._at[entry] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encode texts to 32-bit ids, as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, vocabulary: str, cached: int = 2_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_str(vocabulary)
        self.cached = cached
        self._table, self._older = _Table(), _Table()
        self._words = _Known(self._word)
        self._pieces = _Known(self._piece)
        self._tokenize = self._lib.model.tokenize
        model = json.loads(vocabulary)
        steps = model["normalizer"]["normalizers"] if model["normalizer"] else []
        split = (model["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        #: Word by word is exact only where white space is dropped and words end in a suffix.
        self._by_word = model["model"].get("end_of_word_suffix") == "</w>" and [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and split == _PATTERN

    def _whole(self, text: str) -> list[int]:
        return self._lib.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """Ids of one lower-case word of the pattern."""
        if len(word) > _LONG:
            return self._whole(word)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SPELLED)
        return [t.id for t in self._tokenize(word)]

    def _piece(self, piece: str) -> list[int]:
        """Ids of a piece between white space."""
        if _PLAIN.fullmatch(piece):
            return [i for w in _WORDS(piece.lower()) for i in self._words[w]]
        return self._whole(piece)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        if not self._by_word or any(x in text for x in _ODD):
            return self._whole(text)
        if _plain(text):
            data = np.frombuffer(text.lower().encode(), np.uint8)
            return self._encode_plain(data, np.array([0, len(data)]))[0].tolist()
        self._pieces.bound(self.cached // 4)
        return [i for p in text.split() for i in self._pieces[p]]

    def encode_block(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in turn, and where each text's begin (and the last one's end)."""
        raw, bounds = block.data.tobytes(), block.bounds
        text = raw.decode()
        if self._by_word and _plain(text) and "<|" not in text:
            # Lower case takes as many bytes, for these signs.
            return self._encode_plain(np.frombuffer(text.lower().encode(), np.uint8), bounds)
        parts: list[np.ndarray] = []
        plain: list[int] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            t = raw[lo:hi].decode()
            easy = self._by_word and _plain(t) and "<|" not in t
            plain.append(easy)
            parts.append(np.frombuffer(t.lower().encode(), np.uint8) if easy else np.array(self.encode(t), np.uint32))
        easy = np.array(plain, bool)
        size = np.array([len(p) for p in parts], np.int64)
        inner = [p for p, e in zip(parts, plain, strict=True) if e]
        ids, at = self._encode_plain(np.concatenate([*inner, np.zeros(0, np.uint8)]), np.concatenate(([0], np.cumsum(size[easy]))))
        size[easy] = np.diff(at)
        for k, row in enumerate(np.flatnonzero(easy).tolist()):
            parts[row] = ids[at[k] : at[k + 1]]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum(size)))

    def _encode_plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > 2 * STRETCH and len(bounds) == 2:  # one long text: in stretches that end at white space
            parts, lo = [], 0
            while lo < len(data):
                space = np.flatnonzero(_KIND[data[lo + STRETCH : lo + 2 * STRETCH]] == 0)
                hi = lo + STRETCH + int(space[0]) if len(space) else len(data)
                parts.append(self._encode_words(data[lo:hi], np.array([0, hi - lo]))[0])
                lo = hi
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        return self._encode_words(data, bounds)

    def _encode_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = _cut(data, bounds)
        size = end - start
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        eight = np.ndarray(len(data) + 8, "<u8", padded, 0, (1,))
        a = eight[start] & _KEEP[np.minimum(size, 8)]
        b = eight[start + 8 * (size > 8)] & _KEEP[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > 16)
        entry = self._entries(a, b, start, end, data, long)
        count = self._table.size[entry].astype(np.int64)
        if len(long):
            self._words.bound(self.cached // 4)
            known = [np.array(self._words[data[x:y].tobytes().decode()], np.uint32) for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            count[long] = 0
            ids = self._table.ids(entry, count)
            at = np.concatenate(([0], np.cumsum(count)))[long]
            count[long] = [len(k) for k in known]
            ids = np.insert(ids, np.repeat(at, count[long]), np.concatenate(known))
        else:
            ids = self._table.ids(entry, count)
        edge = np.concatenate(([0], np.cumsum(count)))
        return ids, edge[np.searchsorted(start, bounds)]

    def _entries(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Entries of words in the table; new ones are learned, those of the older table come back."""
        if self._table.n > self.cached // 2:
            self._table, self._older = _Table(), self._table
        a[long] = b[long] = 0  # all long words count as one here, which is the empty word
        entry = self._table.find(a, b)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            order = miss[np.lexsort((b[miss], a[miss]))]
            x, y = a[order], b[order]
            first = order[np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))]
            x, y = a[first], b[first]
            old = self._older.find(x, y)
            known, new = old >= 0, np.flatnonzero(old < 0)
            if known.any():
                size = self._older.size[old[known]]
                self._table.add(x[known], y[known], self._older.ids(old[known], size.astype(np.int64)), size)
            learned = [self._word(data[p:q].tobytes().decode()) if w else [] for p, q, w in zip(start[first[new]].tolist(), end[first[new]].tolist(), x[new].tolist(), strict=True)]
            self._table.add(x[new], y[new], np.array([i for w in learned for i in w], np.uint32), np.array([len(w) for w in learned], np.int32))
            entry[miss] = self._table.find(a[miss], b[miss])
        return entry


def _cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words of lower-case plain texts."""
    n = len(data)
    kind = _KIND[data]
    three = np.flatnonzero(data == 0xE2)
    for k in range(3):
        kind[three + k] = 3
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[1:n] |= kind[1:] == 2  # every digit is a word
    limit = np.zeros(n + 1, bool)
    limit[bounds] = True
    edge = np.flatnonzero(change | limit)
    k = kind[edge[:-1]] if n else kind
    inside = k > 0
    start, end, k = edge[:-1][inside], edge[1:][inside], k[inside]
    # A lone apostrophe takes s, t, re, ve, m, ll or d of the letters after it.
    q = np.flatnonzero((k[:-1] == 3) & (k[1:] == 1) & (end[:-1] == start[1:]) & (end[:-1] - start[:-1] == 1))
    q = q[(data[start[q]] == 39) & ~limit[end[q]]]
    if len(q):
        x = data[end[q]]
        y = np.where(end[q + 1] - start[q + 1] > 1, data[np.minimum(end[q] + 1, n - 1)], 0)
        take = np.isin(x, (115, 116, 109, 100)) + 2 * (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))
        end[q] += take
        start[q + 1] += take
        full = end > start
        start, end = start[full], end[full]
    return start, end


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with ``end_id`` after every text."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


#: Words a worker remembers unless told otherwise, in two halves: some 60 bytes each.
CACHED = 2_000_000

_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: str, cached: int = CACHED) -> Encoder:
    """One encoder for each vocabulary and worker, so that later tasks find its cache filled."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    _encoders[key].cached = cached
    return _encoders[key]


def encoded(docs: DataFrame, tokenizer: str | None, emit: Callable[[Encoder], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str, cached: int = CACHED) -> DataFrame:
    """Apply ``emit(encoder)`` to the batches of ``docs``; the vocabulary (a few MB) is broadcast."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(encoder(vocabulary.value, cached))(batches)

    return docs.mapInArrow(workers.task("tokens", run, _encoders.clear), schema)
