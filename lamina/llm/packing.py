"""Packing token sequences by minimum bin slack.

Each task packs the documents of its partition.  Whole windows of a long document are sequences of their own; the
rest of each document goes to a pool of at most `pool` pieces.  A window takes the longest piece of the pool and
then the multiset of the other lengths whose sum comes closest to what is left of it.  The multiset is found by
bounded subset sums on a bitset (a Python integer), which stop as soon as the window can be filled exactly, and is
read back from the bitsets kept on the way.  What slack remains is filled by a cut of one more piece.  The last,
partly filled window of a task is dealt out to sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled.  Sequence ids hold the partition's number in their upper bits, so they are unique without any
exchange, and a task that runs again gives the same rows, given the same partition.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts with a longer run without a space, or of spaces, go to the slower library.
LONG_RUN = 4096


class Encoder:
    """Token ids of texts as the tokenizer gives them, without tokens of its own before or after.

    A special string in a text becomes its special id, as the file says; with special_as_text it is ordinary text.
    Where the file is a byte-level BPE whose ids follow its merges, a faster library encodes with the same table the
    texts that hold no added token.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", []) if not (special_as_text and t["special"])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and (len(text) < LONG_RUN or _longest_run(text) < LONG_RUN) and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _longest_run(text: str) -> int:
    blank = np.array([c.isspace() for c in text])
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return int(np.diff(np.concatenate([[-1], turns, [len(text) - 1]])).max())


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of which length, among lengths (ascending) and counts, come closest to room from below."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        size = lengths[i]
        left, k = min(counts[size], room // size), 1
        while left > 0:
            n = min(k, left)
            steps.append((size, n, reach))
            reach |= (reach << (size * n)) & mask
            left, k = left - n, 2 * k
        if reach >> room:
            break
    best, used = reach.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not before >> best & 1:
            best -= size * n
            used[size] = used.get(size, 0) + n
    return used


class Packer:
    """Pieces are (document's number, start, ids, document's length)."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.pool: dict[int, list] = {}
        self.size = 0
        self.out: list[tuple] = []

    def put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.size += 1

    def take(self, size: int) -> tuple:
        found = self.pool[size]
        piece = found.pop()
        if not found:
            del self.pool[size]
        self.size -= 1
        return piece

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, ids))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for a in range(0, whole, self.window):
            self.emit([(doc, a, ids[a : a + self.window], len(ids))])
        if whole < len(ids):
            self.put((doc, whole, ids[whole:], len(ids)))

    def pack(self, leave: int) -> None:
        """Fills windows until at most `leave` pieces are left; with leave 0 all, the last window by powers of two."""
        lengths = sorted(self.pool)
        while self.size > leave:
            longest = lengths[-1]
            window = [self.take(longest)]
            if longest not in self.pool:
                lengths.pop()
            used = fill(lengths, {n: len(p) for n, p in self.pool.items()} if len(self.pool) < 32 else _Counts(self.pool), self.window - longest)
            for size, n in used.items():
                window += [self.take(size) for _ in range(n)]
            lengths = [n for n in lengths if n in self.pool] if used else lengths
            slack = self.window - sum(len(p[2]) for p in window)
            if slack and self.size:  # some piece is longer than the slack, or it would have been taken
                doc, start, ids, total = self.take(lengths[-1])
                window.append((doc, start, ids[:slack], total))
                self.put((doc, start + slack, ids[slack:], total))
                lengths = sorted(self.pool)
                slack = 0
            if slack:
                self.last(window)
            else:
                self.emit(window)

    def last(self, window: list[tuple]) -> None:
        total = sum(len(p[2]) for p in window)
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        for size in sizes:
            now = []
            while size:
                doc, start, ids, n = window.pop(0)
                if len(ids) > size:
                    window.insert(0, (doc, start + size, ids[size:], n))
                    ids = ids[:size]
                now.append((doc, start, ids, n))
                size -= len(ids)
            self.emit(now)


class _Counts:
    def __init__(self, pool):
        self.pool = pool

    def __getitem__(self, size):
        return len(self.pool[size])


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, pool: int = 4096, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its text's ids, then end_id; a null or empty text is end_id alone.  Each id lies in one piece; the
    pieces of a sequence follow each other without a gap from offset 0; a sequence has `window` ids, or a power of
    two.  Repeated rows and rows of one id are packed each on its own.  A text of any length is one document; its
    ids stay in memory while it is cut.  An empty table gives no row; other columns are dropped, whatever their names.
    """
    fields = [T.StructField(id, df.schema[id].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    kind = df.schema[id].dataType

    def rows(packer: Packer, arrow) -> pa.RecordBatch:
        columns = list(zip(*packer.out)) if packer.out else [[] for _ in range(8)]
        packer.out = []
        arrays = [pa.array([None if x is None else x for x in columns[0]], arrow)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
        if with_ids:
            arrays.append(pa.array([c.astype(np.int32) for c in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    def run(stream):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        enc = encoder(tokenizer, special_as_text)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        last = np.array([end_id], np.uint32)
        for batch in stream:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = x.as_py()
                packer.add(doc, np.concatenate([enc.ids(s), last]) if s else last)
                if packer.size >= pool:
                    packer.pack(pool // 4)
                if len(packer.out) >= 1 << 13:
                    yield rows(packer, arrow)
        packer.pack(0)
        yield rows(packer, arrow)

    return df.select(f"`{id}`", f"`{text}`").mapInArrow(run, schema)
