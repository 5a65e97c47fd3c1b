import heapq
import random
import time
from collections import defaultdict
from fractions import Fraction

import pytest

from lamina.llm import mixing


def sainte_lague(votes, seats, most):
    """One seat after the other to the highest quotient."""
    out = [0] * len(votes)
    heap = [(-Fraction(v), i) for i, v in enumerate(votes) if most[i]]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_apportionment_by_highest_quotients(seed):
    r = random.Random(seed)
    votes = [r.randrange(1, 1000) for _ in range(r.randrange(1, 8))]
    seats = r.randrange(0, 60)
    most = [r.choice([3, 10, 1000]) for _ in votes]
    got = mixing.apportion(votes, seats, most)
    want = sainte_lague(votes, seats, most)
    assert sum(got) == sum(want)
    key = lambda out: sorted((Fraction(v) / (2 * q + 1), m > q) for v, q, m in zip(votes, out, most))  # noqa: E731  ties may fall either way
    assert got == want or key(got) == key(want)


def test_targets_reshare_what_is_above_the_cap():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 1000, 1000], [10, 1, 1]) == [30, 990, 990]
    assert mixing.targets([1, 10, 1000], [5, 5, 1]) == [3, 30, 978]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def rows(seed=4):
    r = random.Random(seed)
    out = [(i, r.choice(["a", "b", "B", None, "é", "hot", "hot", "hot"]), r.choice([0, 1, 5, 90, 400, None]), r.getrandbits(60)) for i in range(1500)]
    return out + [(9000, "long", 50000, 5), (9001, "tiny", 2, 6), (9002, "none", 0, 7), (9002, "none", 0, 7), (None, "a", 30, None)]


def goals(data):
    names = sorted({x[1] for x in data if x[1] is not None}) + ([None] if any(x[1] is None for x in data) else [])
    size = [sum(x[2] or 0 for x in data if x[1] == s) for s in names]
    return dict(zip(names, size)), dict(zip(names, mixing.targets(size, [1 + i % 3 for i in range(len(names))])))


def check(got, data, off=0.51):
    size, goal = goals(data)
    taken = defaultdict(int)
    for r in got:
        n = r["size"] or 0
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * n + r["cut_length"] <= 3 * n
        assert 0 <= r["cut_start"] and r["cut_start"] + r["cut_length"] <= n
        taken[r["source"]] += r["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= off, (s, taken[s], goal[s])


@pytest.mark.parametrize("shard_words", [1 << 20, 3000, 200])
def test_mix(spark, shard_words):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, size long, key long")
    got = mixing.mix_sources(df, "source", "size", "key", shard_words=shard_words).collect()
    assert sorted((r["doc_id"] or -1, r["key"] or 0) for r in got) == sorted((x[0] or -1, x[3] or 0) for x in data)
    check(got, data)
    again = mixing.mix_sources(df.repartition(7), "source", "size", "key", shard_words=shard_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tiny_and_capped_sources(spark):
    """Targets of a few words, and caps that bind in every one of many shards."""
    r = random.Random(1)
    data = [(0, "a", 1, 1), (1, "b", 2, 2), (2, "c", 7, 3)] + [(10 + i, "d", 47, r.getrandbits(60)) for i in range(64)] + [(100 + i, "e", 100, r.getrandbits(60)) for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long, key long")
    check(mixing.mix_sources(df, "source", "size", "key", shard_words=50).collect(), data)
    _, take = mixing.plan({("a", 0): 2, ("b", 0): 100000}, (1, 2, 3), 3, 16)
    assert take == {("a", 0): 6, ("b", 0): 99996}
    _, take = mixing.plan({**{("a", h): 47 for h in range(64)}, ("b", 0): 100000}, (3, 1), 3, 16)
    assert sum(n for (s, _), n in take.items() if s == "a") == 9024


def test_repeated_rows_share(spark):
    """Equal rows can't be told apart: each gives the same part, so a source misses by at most half a word for each."""
    data = [(1, "a", 100, 7)] * 300 + [(2, "b", 9, 8)] * 3000 + [(i, "c", 50, i) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long, key long")
    got = mixing.mix_sources(df, "source", "size", "key").collect()
    check(got, data, 1500)
    assert len({(r["taken"], r["cut_start"]) for r in got if r["source"] == "a"}) == 1


def test_many_sources_are_planned_in_linear_time():
    r = random.Random(2)
    began = time.perf_counter()
    _, take = mixing.plan({(f"s{i}", 0): r.randrange(1, 10**6) for i in range(50000)}, (1, 2, 3), 3, 16)
    assert len(take) == 50000 and time.perf_counter() - began < 10
    assert mixing.shards_for(10**12, 3 * 10**12) <= 1 << 16 and mixing.shards_for(0, 0) == 1 and mixing.shards_for(1 << 24, 1 << 25) == 16


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "s", 40, 3, "x"), (1, "s", 40, 3, "x")], "doc_id long, source string, size long, target long, shard string")
    got = mixing.mix_sources(df, "source", "size", "target")
    assert got.columns == ["doc_id", "source", "size", "target", "shard", "source_size", "_target", "taken", "copies", "cut_start", "cut_length"]
    assert sum(r["taken"] for r in got.collect()) == 80
    assert mixing.mix_sources(df.limit(0), "source", "size", "target").count() == 0
