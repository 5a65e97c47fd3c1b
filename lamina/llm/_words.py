"""Words, hashes and n-gram keys of Arrow string columns, computed on whole batches with NumPy.

A word is a maximal run of bytes other than space and \\t..\\r.  Those bytes never occur inside a UTF-8
sequence, so all work is done on the encoded bytes.  A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words hashed at a time; bounds the memory that a very long text takes.
_SLICE = 1 << 18
#: Odd multipliers for rolling hashes.
ROLL_A, ROLL_B = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; changes x in place and returns it."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the hashes x."""
    return mix(x ^ U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts.

    start, end: byte ranges in buf.  first: n + 1 word indexes; text i has words first[i]:first[i + 1].
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        self.buf, self.off = flat(column)
        if lower:
            self.buf = _LOWER[self.buf]
        inside = ~_SPACE[self.buf]
        begins, ends = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            some = self.off[1:] > self.off[:-1]
            heads, tails = self.off[:-1][some], self.off[1:][some] - 1
            begins[heads] = inside[heads]
            ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a sum of bytes times position keys, mixed with the length."""
        out = np.empty(len(self.start), U64)
        for a in range(0, len(out), _SLICE):
            s, e = self.start[a : a + _SLICE], self.end[a : a + _SLICE]
            out[a : a + _SLICE] = hash_ranges(self.buf, s, e)
        return out

    def joined(self, keep: np.ndarray | None = None) -> pa.Array:
        """The (kept) words of each text, joined by one space. keep: a flag for each word of the batch."""
        start, end, doc = self.start, self.end, self.doc()
        if keep is not None:
            start, end, doc = start[keep], end[keep], doc[keep]
        n = end - start
        sizes = n.copy()
        sizes[:-1] += doc[1:] == doc[:-1]  # the space after it
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        out = np.full(total, 32, np.uint8)
        for a in range(0, len(n), _SLICE):
            k = n[a : a + _SLICE]
            where = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(at[a : a + _SLICE], k) + where] = self.buf[np.repeat(start[a : a + _SLICE], k) + where]
        offsets = np.concatenate([at, [total]])[np.searchsorted(doc, np.arange(len(self) + 1))]
        if total < 1 << 31:
            return pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; empty ranges share one value."""
    out = np.zeros(len(start), U64)
    sizes = end - start
    full = np.flatnonzero(sizes > 0)
    if len(full):
        s, n = start[full], sizes[full]
        at = np.cumsum(n) - n
        where = np.arange(int(n.sum())) - np.repeat(at, n)
        keys = mix(np.arange(1, int(n.max()) + 1, dtype=U64) * ROLL_A)
        values = buf[np.repeat(s, n) + where].astype(U64)
        values += U64(1)
        values *= keys[where]
        out[full] = np.add.reduceat(values, at)
    return mix(out ^ (sizes.astype(U64) * ROLL_B))


def _powers(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, size: int, base: U64 = ROLL_A) -> np.ndarray:
    """Hashes of all runs of `size` consecutive items; those that cross two texts are for the caller to mask."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    inverse = U64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers(inverse, n))


def shingles(w: Words, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle of each text, sorted by text and hash.

    A text with fewer than `size` words, but at least one, has one shingle: its whole word sequence.
    """
    counts = w.counts
    runs = rolling(words, size)
    doc = np.repeat(np.arange(len(w)), np.maximum(counts - size + 1, 0))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0), np.maximum(counts - size + 1, 0))
    keys = runs[w.first[doc] + at] if len(doc) else np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([rolling(words[w.first[i] : w.first[i + 1]], counts[i])[0] for i in short], U64)
        keys = np.concatenate([keys, salted(whole, 7) + counts[short].astype(U64)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return doc[new], keys[new]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


def batches(stream, column: str, most: int = 4 << 20):
    """The Arrow batches of a stream, cut so that `column` has at most `most` bytes in each (or one row)."""
    for batch in stream:
        if batch.num_rows:
            at = batch.schema.get_field_index(column)
            for a, b in slices(flat(batch.column(at))[1], most):
                yield batch.slice(a, b - a)
