"""Words of whole Arrow text columns as numpy arrays: spans, names, hashes, window hashes.

A word's name of 128 bits says which word it is; its 64-bit hash is made of it by a mixing
function, and the hash of a run of words by mixing those of its halves. No sum of powers is
involved, so texts of a regular build (as the Thue-Morse word, on which polynomials modulo
2^64 agree) collide no more than others. Hashes find candidates; operators whose results would
be wrong on a collision verify by names or by the words themselves.

All work is vectorised over a chunk of documents of bounded size; a document larger than
the bound is a chunk by itself, so no text is ever cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

#: Separators by byte. In UTF-8 all bytes of non-ASCII characters are 0x80 and above.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    NON_ALNUM[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words of at most so many bytes are named by their bytes, longer ones by a digest of them.
PLAIN = 15
#: Odd multipliers, one for each salt.
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[raw[0] : raw[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, raw - raw[0]


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text and ``rows`` rows, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64) + 16
        total, at = np.cumsum(sizes), 0
        while at < n:
            before = total[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(total, before + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a chunk: byte spans, and for each document the index of its first word
    (``first`` has one entry more than there are documents)."""

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], separators: np.ndarray = BLANK, lower: bool = False):
        data, offsets = column if isinstance(column, tuple) else text_bytes(column)
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        if not n:
            self.starts = self.ends = np.empty(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = ~separators[data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each word, as two halves: of a word of ``PLAIN`` bytes or fewer its
        bytes and their number, of a longer one a digest. Different words have different ones."""
        if self._names is None:
            n = len(self.data)
            padded = np.zeros(n + 16, np.uint8)
            padded[:n] = self.data
            at_every_byte = np.ndarray((n + 9,), "<u8", padded, strides=(1,))
            size = self.ends - self.starts
            low, high = at_every_byte[self.starts], at_every_byte[self.starts + 8]
            for half, left in ((low, size), (high, size - 8)):
                few = left < 8
                half[few] &= (np.uint64(1) << (np.maximum(left[few], 0).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            high &= np.uint64((1 << 56) - 1)
            high |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
            long = np.flatnonzero(size > PLAIN)
            if len(long):
                view, known = memoryview(padded), {}
                for i, a, b in zip(long.tolist(), self.starts[long].tolist(), self.ends[long].tolist(), strict=True):
                    word = bytes(view[a:b])
                    name = known.get(word)
                    if name is None:
                        name = known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=16).digest(), "little")
                    low[i] = name & (1 << 64) - 1
                    high[i] = name >> 64 | 0xFF << 56
            self._names = low, high
        return self._names

    _names: tuple[np.ndarray, np.ndarray] | None = None

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's name."""
        low, high = self.names()
        return mix(low ^ mix(high + np.uint64(ODD[salt])))


def join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The hash of two neighbours by theirs."""
    return mix(a * np.uint64(ODD[salt]) + mix(b ^ np.uint64(ODD[salt - 1])))


def windows(hashes: np.ndarray, first: np.ndarray, length: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside one document, and the index of the
    first word of each. Runs of 2, 4, 8 ... words are made of two halves; one of another length
    of two such runs that overlap."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, span = hashes, 1
    while span * 2 <= length:
        h, span = join(h[:-span], h[span:], salt), span * 2
    if span < length:
        h = join(h[: n - length + 1], h[length - span :], salt)
    ok = np.ones(n - length + 1, bool)
    for cut in np.unique(first[(first > 0) & (first < n)]):
        ok[max(0, cut - length + 1) : cut] = False
    at = np.flatnonzero(ok)
    return h[at], at


def owner(index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The document of each word index."""
    return np.searchsorted(first, index, side="right") - 1
