import random

import numpy as np
import pytest

from lamina.llm import jaccard
from lamina.llm._components import connected_components

from .common import DOCS, corpus, lower, words


def shingle_set(text, size):
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def brute(docs, size, percent):
    """(id, set size, least id of the component)."""
    s = [shingle_set(t, size) for _, t in docs]
    root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if linked(s[i], s[j], percent)])
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[i] and docs[j][0] is not None]
        out.append((d, len(s[i]), min(ids) if ids else None))
    return out


def family(r, n, size, changes):
    base = [f"v{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w[: r.randrange(size * 9 // 10, size + 1)]))
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_against_brute_force(spark, size, percent):
    r = random.Random(size)
    docs = corpus(size) + [(200 + i, t) for i, t in enumerate(family(r, 40, 200, 6) + family(r, 20, 12, 1))]
    docs += [(400, "A b C"), (401, "a B c"), (402, "a b c a b c"), (403, "x y"), (404, "X  Y"), (405, "x y z")]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), size=size, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(docs, size, percent))


@pytest.mark.parametrize("seed", range(6))
def test_link_sets(seed):
    r = random.Random(seed)
    percent = r.choice([50, 80, 90])
    sets = [set(r.sample(range(60), r.randrange(1, 12))) for _ in range(80)]
    base = set(range(1000, 1100))
    for _ in range(120):
        sets.append((base - set(r.sample(sorted(base), r.randrange(12)))) | {r.randrange(2000, 9000) for _ in range(r.randrange(6))})
    got = jaccard.link_sets([np.array(sorted(s), np.uint64) for s in sets], percent)
    want = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], percent)])
    assert got.tolist() == want


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    r = random.Random(9)
    docs = list(enumerate(family(r, 150, 120, 8) + family(r, 30, 60, 3)))
    split = jaccard.linked_sets
    monkeypatch.setattr(jaccard, "linked_sets", lambda s, p: split(s, p, most_items=700))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), size=2, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(docs, 2, 85))


def test_keep_marks_one_row_of_each_component(spark):
    docs = [(3, "a b c d", "p"), (1, "A b c d", "q"), (1, "A b c d", "q"), (None, "a b c d", "r"), (5, None, "s"), (6, "", "t"), (7, " \n", "u"), (None, None, "v")]
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    got = jaccard.jaccard_components(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted([("3", 2, "1"), ("1", 2, "1"), ("1", 2, "1"), ("None", 2, "1"), ("5", 0, "5"), ("6", 0, "6"), ("7", 0, "7"), ("None", 0, "None")])
    assert len({(r["doc_id"], r["row_key"]) for r in got if r["keep"]}) == 5
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100)] + [(300, 200), (5, 5), (400, 400)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_group_of_near_copies_needs_no_pairs_of_blocks(spark, monkeypatch):
    r = random.Random(4)
    docs = list(enumerate(family(r, 200, 100, 1)))
    calls = []
    real = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda t, p: calls.append(t.select("task").distinct().count()) or real(t, p))
    split = jaccard.linked_sets
    monkeypatch.setattr(jaccard, "linked_sets", lambda s, p: split(s, p, most_items=2000))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), size=2, percent=70).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(docs, 2, 70))
    assert calls[1] > 2 and calls[3:] == [0]  # several blocks; nothing is left to meet by shingles


@pytest.mark.parametrize("n", [60, 240])
def test_a_chain_of_chance_costs_no_pairs_of_blocks(spark, monkeypatch, n):
    """Each text shares a passage with the next one and is like none but for a few pairs: one group, tasks in proportion to its blocks."""
    texts = [" ".join([f"s{i}x{k}" for k in range(14)] + [f"own{i}x{k}" for k in range(10)] + [f"s{i + 1}x{k}" for k in range(14)]) for i in range(n)]
    texts += [t.replace("own7x", "own7y", 1) for t in texts[::20]]
    docs = list(enumerate(texts))
    calls = []
    real, split = jaccard._links, jaccard.linked_sets
    monkeypatch.setattr(jaccard, "_links", lambda t, p: calls.append(t.select("task").distinct().count()) or real(t, p))
    monkeypatch.setattr(jaccard, "linked_sets", lambda s, p: split(s, p, most_items=400))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), size=2, percent=50).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(docs, 2, 50))
    blocks = -(-37 * n // 400)
    assert calls[1] >= blocks / 2 and sum(calls) <= 12 * blocks + 10


@pytest.mark.parametrize("percent", [60, 90])
def test_one_shingle_in_too_many_sets(spark, monkeypatch, percent):
    """All sets share one passage, and only pairs of them are alike; a block holds two sets."""
    r = random.Random(percent)
    docs = list(enumerate(f"same passage here in all {f} and then {' '.join(f'q{r.randrange(30)}' for _ in range(3))}" for f in family(r, 24, 8, 2) + family(r, 24, 8, 2)))
    split = jaccard.linked_sets
    monkeypatch.setattr(jaccard, "linked_sets", lambda s, p: split(s, p, most_items=30))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), size=1, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(docs, 1, percent))
