"""Quality rules as a short-circuit cascade.

Each rule rejects texts by a measure of its own.  On a sample drawn from all of the table, workers measure the seconds
that each rule takes, beyond what all share, and the share of texts that it rejects; the rules then run in descending
order of rejections per second, each on the texts that all rules before it have left.  Measures that are outputs, and
words and their hashes, are there anyway, so a rule on them costs next to nothing; what a rule needs beyond them is
computed for the texts still alive alone.  The verdict is that of all rules together and does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import fresh
from ._words import Words, batches, hash_ranges, rolling

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Measures:
    """Measures of the texts of a batch; each is computed once, when a rule or an output first asks for it.

    live: the texts still of interest; what is costly is left out for the others.  work: the words that each costly
    measure went through.
    """

    def __init__(self, column):
        self.words = Words(column)
        self.live = np.ones(len(self.words), bool)
        self.known: dict[str, np.ndarray] = {}
        self.work: dict[str, int] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, "_" + name)()
        return self.known[name]

    def fork(self) -> Measures:
        """The same texts, with what is known so far."""
        out = Measures.__new__(Measures)
        out.words, out.live, out.known, out.work = self.words, self.live, dict(self.known), {}
        return out

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[self.words.off])

    def _hashes(self) -> np.ndarray:
        return self.words.hashes()

    def _doc(self) -> np.ndarray:
        return self.words.doc()

    def _alive(self, name: str, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, and the given arrays, of the words of live texts."""
        doc = self.get("doc")
        if not self.live.all():
            on = self.live[doc]
            doc, arrays = doc[on], tuple(x[on] for x in arrays)
        self.work[name] = len(doc)
        return doc, *arrays

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _word_chars(self) -> np.ndarray:
        return self._per_text(self.words.inside & ((self.words.buf & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self.words.buf])

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of each line with a word."""
        w = self.words
        breaks = np.flatnonzero(w.buf == 10)
        start = np.concatenate([w.off[:-1], breaks + 1])
        end = np.concatenate([breaks, w.off[1:]])
        doc = np.concatenate([np.arange(len(w)), np.searchsorted(w.off, breaks, "right") - 1])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        order = np.lexsort((end, np.concatenate([np.searchsorted(w.off, breaks, "right") - 1, np.arange(len(w))])))
        end = end[order]
        sums = np.concatenate([[0], np.cumsum(w.inside)])
        some = sums[end] > sums[start]
        return doc[some], start[some], end[some]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.get("lines")[0], minlength=len(self.words))

    def _n_dup_lines(self) -> np.ndarray:
        doc, start, end = self.get("lines")
        on = self.live[doc]
        doc, keys = doc[on], hash_ranges(self.words.buf, start[on], end[on])
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        again = (doc[1:] == doc[:-1]) & (keys[1:] == keys[:-1])
        return np.bincount(doc[1:][again], minlength=len(self.words))

    def _windows(self, name: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text of each live word; of each window its first word's index, in the order of (text, hash), and whether the one before is equal."""
        doc, hashes = self._alive(name, self.get("hashes"))
        runs = rolling(hashes, size)
        at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
        order = at[np.lexsort((runs[at], doc[at]))]
        same = np.zeros(len(order), bool)
        same[1:] = (doc[order][1:] == doc[order][:-1]) & (runs[order][1:] == runs[order][:-1])
        return doc, order, same, np.append(same[1:], False)

    def _repeated(self, name: str, size: int) -> np.ndarray:
        """Words in windows of so many words that come twice or more in the text, the first one included."""
        doc, order, same, next_same = self._windows(name, size)
        hit = order[same | next_same]
        cover = np.zeros(len(doc), bool)
        for k in range(size):
            cover[hit + k] = True
        return np.bincount(doc[cover], minlength=len(self.words))

    def _n_repeat_words(self) -> np.ndarray:
        return self._repeated("n_repeat_words", 3)

    def _n_long_repeat_words(self) -> np.ndarray:
        return self._repeated("n_long_repeat_words", 8)

    def _top_pair(self) -> np.ndarray:
        """How often the commonest two-word window comes."""
        doc, order, same, _ = self._windows("top_pair", 2)
        first = np.flatnonzero(~same)
        out = np.zeros(len(self.words), np.int64)
        np.maximum.at(out, doc[order[first]], np.diff(np.append(first, len(order))))
        return out

    def _n_letterless(self) -> np.ndarray:
        """Words without a letter: of bytes that are ASCII and neither a to z nor A to Z."""
        doc, start, end = self._alive("n_letterless", self.words.start, self.words.end)
        sums = np.concatenate([[0], np.cumsum(_LETTER[self.words.buf])])
        return np.bincount(doc[sums[end] == sums[start]], minlength=len(self.words))

    def _n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        doc, h = self._alive("n_stutters", self.get("hashes"))
        return np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=len(self.words))


@dataclass(frozen=True)
class Rule:
    """Rejects texts with 100 * measure > percent * base."""

    name: str
    measure: str
    percent: int
    base: str = "n_words"

    def rejects(self, m: Measures) -> np.ndarray:
        return 100 * m.get(self.measure) > self.percent * m.get(self.base)


#: What clean prose stays far below.
RULES = (
    Rule("symbols", "n_symbols", 10),
    Rule("duplicate lines", "n_dup_lines", 30, "n_lines"),
    Rule("stutters", "n_stutters", 20),
    Rule("repeated windows", "n_repeat_words", 30),
    Rule("long words", "word_chars", 1500),
    Rule("no letters", "n_letterless", 40),
    Rule("one pair", "top_pair", 20),
    Rule("repeated passages", "n_long_repeat_words", 30),
)


def judge(m: Measures, order: Sequence[Rule], required: Callable[[Measures], np.ndarray] | None = None) -> np.ndarray:
    """Per text the place of the rule that rejects it, -1 for `required`, -2 for none; each rule sees the texts left."""
    by = np.full(len(m.words), -2)
    if required is not None:
        by[required(m)] = -1
    for i, rule in enumerate(order):
        m.live = by == -2
        if not m.live.any():
            break
        by[m.live & rule.rejects(m)] = i
    return by


def plan(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, outputs: Sequence[str] = (), required: Callable[[Measures], np.ndarray] | None = None, sample: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """The rules with their seconds per text and share of rejections, in the order to run.

    Measured on the workers, on about `sample` rows drawn at random from the whole table, of which only sums come to
    the driver.  A rule's time is its own: words, hashes, outputs and `required` are computed before it starts.
    """
    total = df.count()

    def measure(stream):
        sums = np.zeros((len(rules), 3))
        for batch in batches(stream, text, 1 << 20):
            m = Measures(batch.column(0))
            for name in ("doc", "hashes", *outputs):
                m.get(name)
            if required is not None:
                m.live = ~required(m)
            for i, rule in enumerate(rules):
                own = m.fork()
                began = time.perf_counter()
                rejected = rule.rejects(own) & m.live
                sums[i] += time.perf_counter() - began, rejected.sum(), m.live.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["rule", "seconds", "rejected", "n"])

    some = df.select(f"`{text}`").sample(False, min(1.0, sample / max(total, 1)), seed)
    rows = some.mapInArrow(measure, "rule int, seconds double, rejected double, n double").groupBy("rule").sum("seconds", "rejected", "n").collect()  # a row for each rule
    found = {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in rows}
    return sorted(((rule, *found.get(i, (0.0, 0.0))) for i, rule in enumerate(rules)), key=lambda r: (-r[2] / max(r[1], 1e-9), r[0].name))


def quality_cascade(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, outputs: Sequence[str] = (), required: Callable[[Measures], np.ndarray] | None = None, sample: int = 2000) -> DataFrame:
    """df with the measures named in outputs, rejected_by (the first rule, in cascade order, or null) and kept.

    required: an own test, applied before the cascade; texts that it rejects get rejected_by "required".  A null text
    counts as empty, with all measures 0; without `required`, no rule rejects it.  A text of any length is judged as a
    whole, by the task that reads it.  Measures in outputs are computed for all texts, others only for those still
    alive.  Rows, ties and repeats are judged one by one; an empty table stays empty.  Names get underscores in front
    where they clash.
    """
    order = [r for r, _, _ in plan(df, text, rules, outputs, required, sample)]
    added = fresh(df, *outputs, "rejected_by", "kept")
    fields = list(df.schema.fields) + [T.StructField(n, T.LongType()) for n in added[:-2]] + [T.StructField(added[-2], T.StringType()), T.StructField(added[-1], T.BooleanType())]
    names = [f.name for f in fields]

    def run(stream):
        for batch in batches(stream, text):
            m = Measures(batch.column(batch.schema.get_field_index(text)))
            values = [m.get(n) for n in outputs]
            by = judge(m, order, required)
            label = [None if b == -2 else "required" if b == -1 else order[b].name for b in by]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v.astype(np.int64)) for v in values), pa.array(label, pa.string()), pa.array(by == -2)], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def too_short_or_repetitive(m: Measures) -> np.ndarray:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    n = m.get("n_words")
    return (n < 50) | (100 * m.get("n_repeat_words") > 50 * n)
