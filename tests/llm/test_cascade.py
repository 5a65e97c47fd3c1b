import time
from collections import Counter

import numpy as np
import pyarrow as pa

from lamina.llm import cascade

from .common import DOCS, corpus, words


def brute(text):
    text = text or ""
    w = words(text)
    lines, dup, seen = [x for x in text.split("\n") if words(x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)

    def again(size):
        windows = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        return len({i + k for i in range(len(w) - size + 1) if windows[tuple(w[i : i + size])] > 1 for k in range(size)})

    pairs = Counter(zip(w, w[1:]))
    bare = sum(not any("a" <= c.lower() <= "z" or c > "\x7f" for c in x) for x in w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, again(3), len(lines), sum(a == b for a, b in zip(w, w[1:])), bare, max(pairs.values(), default=0), again(8)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_letterless", "top_pair", "n_long_repeat_words")


def cases():
    return corpus(3) + [(200, "a b\na b\n\n \na b\r\nc"), (201, "x y z x y z x y"), (202, "### a|b <c>"), (203, "w w w w"), (204, "la la la " * 40), (205, "l\nl" * 60), (206, " ".join(f"{i} a{i}" if i % 3 else f"{i}! -{i}" for i in range(80))), (207, " ".join(f"x y z{i}" for i in range(60))), (208, " ".join(f"p{i}" for i in range(90)) + " " + " ".join(f"p{i}" for i in range(25)))]


def test_measures_and_verdicts(spark):
    docs = cases()
    got = {r["doc_id"]: r for r in cascade.quality_cascade(spark.createDataFrame(docs, DOCS), outputs=NAMES, required=cascade.too_short_or_repetitive).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        n, chars, symbols, dup, repeat, lines, stutters, bare, pair, far = brute(text)
        assert tuple(got[d][k] for k in NAMES) == (n, chars, symbols, dup, repeat, lines, stutters, bare, pair, far)
        base = n < 50 or 100 * repeat > 50 * n
        bad = 100 * symbols > 10 * n or 100 * dup > 30 * lines or 100 * stutters > 20 * n or 100 * repeat > 30 * n or 100 * chars > 1500 * n
        bad = bad or 100 * bare > 40 * n or 100 * pair > 20 * n or 100 * far > 30 * n
        assert (got[d]["rejected_by"] == "required") == base
        assert got[d]["kept"] == (not base and not bad)


def test_order_changes_no_verdict(spark):
    df = spark.createDataFrame(cases(), DOCS)
    a = {r["doc_id"]: r["kept"] for r in cascade.quality_cascade(df).collect()}
    b = {r["doc_id"]: r["kept"] for r in cascade.quality_cascade(df, rules=cascade.RULES[::-1], sample=1).collect()}
    assert a == b


def test_plan_puts_rejections_per_second_first(spark):
    ranked = cascade.plan(spark.createDataFrame(cases(), DOCS), "text", cascade.RULES)
    gains = [reject / max(seconds, 1e-9) for _, seconds, reject in ranked]
    assert gains == sorted(gains, reverse=True) and len(gains) == len(cascade.RULES)


class Slow(cascade.Rule):
    """Rejects as the rule does, and takes 20 ms more for each batch."""

    def rejects(self, m):
        time.sleep(0.02)
        return super().rejects(m)


def test_a_dear_selective_rule_and_a_cheap_weak_one(spark):
    """Rejections per cost, not rejections or cost alone; and the sample is spread, so rows at the end count too."""
    texts = [(i, "good text %d " % i * 30 + ("* " * 40 if i % 10 == 0 else "") + ("\n" + "same line\n" * 30 if i % 2 else "")) for i in range(400)]
    df = spark.createDataFrame(texts, DOCS).coalesce(2)
    dear, weak, cheap = Slow("dear", "n_dup_lines", 30, "n_lines"), cascade.Rule("weak", "n_symbols", 10), cascade.Rule("cheap", "n_dup_lines", 30, "n_lines")
    assert [r.name for r, _, _ in cascade.plan(df, "text", (dear, weak))] == ["weak", "dear"]
    assert [r.name for r, _, _ in cascade.plan(df, "text", (weak, cheap), outputs=("n_symbols", "n_lines", "n_dup_lines"))][0] == "cheap"
    shares = {r.name: share for r, _, share in cascade.plan(df, "text", (dear, weak), sample=200)}
    assert 0.35 < shares["dear"] < 0.65 and 0.02 < shares["weak"] < 0.25


def test_rules_run_on_the_texts_left_alone():
    texts = pa.array(["# # # " * 100, "a b c d e f g h", None, " ".join(f"v{i}" for i in range(60))])
    m = cascade.Measures(texts)
    order = (cascade.Rule("symbols", "n_symbols", 10), cascade.Rule("far", "n_long_repeat_words", 20), cascade.Rule("pair", "top_pair", 20))
    by = cascade.judge(m, order, lambda m: m.get("n_words") < 5)
    assert by.tolist() == [0, -2, -1, -2]
    assert m.work == {"n_long_repeat_words": 68, "top_pair": 68}  # the 300 words of the first text are left out
    m = cascade.Measures(texts)
    cascade.judge(m, order[1:] + order[:1])
    assert m.work == {"n_long_repeat_words": 368, "top_pair": 68}
    assert np.array_equal(cascade.judge(cascade.Measures(texts), order) == -2, cascade.judge(cascade.Measures(texts), order[::-1]) == -2)


def test_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, True), (1, None, True)], "doc_id long, text string, kept boolean")
    got = cascade.quality_cascade(df)
    assert got.columns == ["doc_id", "text", "kept", "rejected_by", "_kept"]
    assert [r["_kept"] for r in got.collect()] == [True, True]  # no rule rejects an empty text
    assert cascade.quality_cascade(df.limit(0)).count() == 0
