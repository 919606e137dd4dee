import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def by_hand(sizes: dict, share=1.5, cap=2.0):
    """Targets as the words say: share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_hand(spark, seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(r.randint(1, 9))] + ["é", "Z", ""][: r.randint(0, 3)] + [None] * r.randint(0, 1)
    sizes = {n: r.choice([0, 1, 10, 100, 1000, 30000]) * r.randint(1, 9) for n in names}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = by_hand(sizes)
    assert got == pytest.approx(want, abs=1e-4), sizes


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(5)
    rows = [(i, None if i % 50 == 0 else " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", "d", None]), "x") for i in range(2000)]
    rows += rows[:20] + [(None, "one two", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").selectExpr("*", "1 as size", "2 as range", "3 as u", "4 as rate")
    a = sorted(map(tuple, mixing.mix(df).collect()), key=str)
    assert a == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert len(a) == len(rows)
    of = {i: s for i, _, s, _ in rows}
    size_of = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    taken, source = defaultdict(int), {}
    for i, size, source_size, target, t in a:
        assert size == size_of[i] and t in (0, size, 2 * size)
        taken[of[i]] += t
        source[of[i]] = target
    for name, words in taken.items():
        assert source[name] - 3 <= words <= source[name] + 1e-6, (name, words, source[name])
    assert mixing.mix(df.limit(0)).count() == 0
    assert [x.taken for x in mixing.mix(df.withColumn("text", F.lit(" "))).limit(3).collect()] == [0, 0, 0]


def test_short_texts_are_tilted_down(spark):
    """In a source that is taken in part, the share of a size's words follows the tilted base rate of that size."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([2, 20, 300])), "abc"[i % 3]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.9).collect()
    of = {i: s for i, _, s in rows}
    rate = {}
    for s in "abc":
        for size in (2, 20, 300):
            mine = [x for x in got if of[x.doc_id] == s and x.size == size]
            rate[s, size] = sum(x.taken for x in mine) / sum(x.size for x in mine)
    for s in "bc":
        base = {size: size / (size + mixing.HALF) for size in (2, 20, 300)}
        for size in (2, 20):
            assert rate[s, size] / rate[s, 300] == pytest.approx(base[size] / base[300], abs=0.06)


def solved(cells, target, cap):
    """exp(lambda) by halving."""
    low, high = 0.0, max(cap / b for b, _ in cells)
    for _ in range(300):
        m = (low + high) / 2
        low, high = (m, high) if sum(t * min(cap, b * m) for b, t in cells) < target else (low, m)
    return high


def test_newton_solves_the_dual_with_unlike_base_rates(spark):
    r = random.Random(7)
    of = {"a": ([(1, 1000), (0.05, 300), (5, 500)], 2500), "b": ([(1, 1000), (0.5, 1000), (0.001, 100)], 3000), "c": ([(1, 1000), (0.9, 1000), (1e-6, 1)], 1200), None: ([(1, 100), (0.1, 300), (3, 50)], 90), "full": ([(0.2, 10), (7, 30)], 80), "zero": ([(1, 10)], 0)}
    for i in range(60):
        cells = [(math.exp(r.uniform(-9, 9)), r.choice([1, 50, 7000, 10**9])) for _ in range(r.randint(1, 60))]
        of[f"r{i}"] = (cells, r.choice([1e-6, 0.01, 0.3, 0.999, 1.0]) * 2 * sum(t for _, t in cells))
    rows = [(s, float(b), float(t), float(goal)) for s, (cells, goal) in of.items() for b, t in cells] + [("empty", 1.0, 0.0, 0.0)]
    got = defaultdict(list)
    for x in mixing.balanced_rates(spark.createDataFrame(rows, "source string, base double, tokens double, target double")).collect():
        got[x.source].append(x)
    for s, (cells, goal) in of.items():
        assert sum(x.tokens * x.rate for x in got[s]) == pytest.approx(goal, rel=1e-6, abs=1e-9)
        m = solved(cells, goal, 2) if goal else 0.0
        for x in got[s]:
            assert x.rate == pytest.approx(min(2, x.base * m), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("cells", [[("a", 1.0, 10.0, 20.1)], [("a", 1.0, 0.0, 5.0)]])
def test_targets_that_no_rates_meet_raise(spark, cells):
    with pytest.raises(Exception, match="no rates meet"):
        mixing.balanced_rates(spark.createDataFrame(cells, "source string, base double, tokens double, target double")).collect()


def test_sources_are_ordered_over_ranges(spark):
    names = [f"{c}{i}" for i in range(300) for c in "aZé\U0001F600"] + [None, "", "\uffff"]
    got = {x.source: x.i for x in mixing.ordered(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    want = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: i for i, n in enumerate(want)}
