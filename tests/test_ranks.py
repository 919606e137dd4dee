"""Ranks over ranges against pandas, with nulls, ties, hot values, groups of one and many more ranges than a lot."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, network, ranks, sequence


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 20)


def _rows(seed=3, rows=4000):
    """A third of the rows in one group, and a third of these with one value; some without a value or a group."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        g = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{r.randrange(6)}"
        v = 7.0 if g == "hot" and r.random() < 0.34 else None if r.random() < 0.05 else round(r.gauss(0, 20), 1)
        out.append((i, g, v, r.random() < 0.5))
    return [*out, (rows, "alone", 1.0, True), (rows + 1, "empty", None, True)]


def _told(df, name):
    return {x["i"]: None if x[name] is None else round(x[name], 9) for x in df.select("i", name).collect()}


def test_ranks_equal_those_of_pandas(spark, small_ranges):
    rows = _rows()
    df = spark.createDataFrame(rows, "i long, g string, v double, train boolean").repartition(5)
    p = pd.DataFrame(rows, columns=["i", "g", "v", "train"])
    p["g"] = p["g"].fillna("(null)")
    number = lambda s: {i: None if math.isnan(x) else round(x, 9) for i, x in zip(p["i"], s)}
    assert _told(ranks.with_rank_pct(df, ["g"], "v", "o"), "o") == number(p.groupby("g")["v"].rank(pct=True))
    # Ties by i, which is the order of the rows.
    first, n = p.groupby("g")["v"].rank(method="first") - 1, p.groupby("g")["v"].transform("count")
    assert _told(ranks.with_rank_unit(df, ["g"], "v", "i", "o"), "o") == number((first / (n - 1)).where(n > 1))
    want = (first * 4 / (n - 1)).where(n > 1, first).map(lambda x: x if math.isnan(x) else max(1, math.ceil(x)))
    assert _told(ranks.with_quantile(df, ["g"], "v", "i", 4, "o"), "o") == number(want)


def test_train_percentile_with_fallback(spark, small_ranges):
    rows = [(i, g, v, t and g != "g1") for i, g, v, t in _rows(5, 900)]
    df = spark.createDataFrame(rows, "i long, g string, v double, train boolean").withColumn("all", F.lit(1))
    got = _told(sequence.train_percentile(df, ["g"], ["all"], "v", "train", 20), "pct")
    for i, g, v, _ in rows:
        pool = [x[2] for x in rows if x[1] == g and x[3] and x[2] is not None]
        everyone = [x[2] for x in rows if x[3] and x[2] is not None]
        has_group = any(x[1] == g and x[2] is not None for x in rows)
        pool, use = (pool, len(pool) >= 20) if pool else (everyone, has_group)
        assert got[i] == (round(sum(x < v for x in pool) / len(pool), 9) if use and v is not None else None), (i, g)


def test_ranges_are_monotone_and_filled(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 10)
    values = [float(x) for x in range(5000)] + [float("inf"), float("-inf"), float("nan"), None]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", ranks.ranges(df, "v")[0].alias("b")).collect()
    known = sorted((x.v, x.b) for x in got if x.v is not None and x.v == x.v)
    assert [b for _, b in known] == sorted(b for _, b in known) and len({b for _, b in known}) > 400
    assert max(pd.Series([b for _, b in known]).value_counts()) < 30
    assert next(x.b for x in got if x.v is None) == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", 2.0), (2, "a", 2.0)]])
def test_little_or_nothing(spark, rows):
    df = spark.createDataFrame(rows, "i long, g string, v double")
    assert ranks.with_rank_pct(df, ["g"], "v").count() == ranks.with_quantile(df, ["g"], "v", "i", 10).count() == len(rows)
    assert sequence.previous_keys(df, "g", "i").count() == max(0, len(rows) - 1)


def test_previous_keys_with_one_key_far_off(spark, small_ranges):
    keys = list(range(0, 3000, 3)) + [10**15]
    df = spark.createDataFrame([(k, "s" if k % 2 else None) for k in keys], "k long, s string")
    want = {}
    for parity in (0, 1):
        own = [k for k in keys if k % 2 == parity]
        want |= dict(zip(own[1:], own))
    assert {x.k: x.prev for x in sequence.previous_keys(df, "s", "k").collect()} == want


def test_median_imputation(spark, small_ranges):
    rows = [(i, float(i % 7) if i % 5 else None, 1000.0 * i if i % 3 else None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, a double, b double, none double")
    got = {x.i: x for x in models.impute_median(df, ["a", "b", "none"], F.col("i") < 150, 1).collect()}
    p = pd.DataFrame(rows[:150], columns=["i", "a", "b", "none"])
    assert got[0].a == p["a"].median() and got[0].b == p["b"].median() and got[0].none == 0.0
    assert got[0].a_missing == 1.0 and got[1].a == 1.0 and "none_missing" not in got[0]


def test_medians_are_looked_up_once(spark, small_ranges):
    """What is fitted reads the imputed rows many times over, so their plan must not order the values again."""
    df = spark.range(0, 500).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("a"), F.lit(None).cast("double").alias("none"))
    got = models.impute_median(df, ["a", "none"], F.col("id") < 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and {(r.a, r.none) for r in got.where("id % 3 = 0").collect()} == {(49.5, 0.0)}


@pytest.mark.parametrize("at_once", [0, 2_000_000])
def test_firms_that_share_persons_get_lists(spark, monkeypatch, at_once):
    """What is shuffled follows the links and not the pairs of firms, with the pairs of a firm counted as an array or as rows."""
    monkeypatch.setattr(network, "PAIRS_AT_ONCE", at_once, raising=False)
    r = random.Random(2)
    links = [(f, p) for p in range(300) for f in r.sample(range(1500), 40)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {x.firm: (x.linked, x.flagged) for x in network.linked(spark.createDataFrame(links, "firm long, person long"), spark.createDataFrame([(f,) for f in range(0, 1500, 9)], "firm long")).collect()}
    sent = written() - before
    firms, want = {}, {}
    for f, p in links:
        firms.setdefault(p, set()).add(f)
    for f, p in links:
        want.setdefault(f, set()).update(firms[p] - {f})
    assert got == {f: (len(o), sum(x % 9 == 0 for x in o)) for f, o in want.items()} and sum(map(len, want.values())) > 400_000
    assert sent < 4_000_000, sent


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_firms_that_share_persons(spark, hot):
    r = random.Random(hot)
    links = [(f"f{r.randrange(40)}", r.choice(["p0", f"p{r.randrange(30)}"])) for _ in range(150)] + [(None, "p0"), ("f1", None), ("lonely", "nobody")]
    flagged = {f"f{i}" for i in range(0, 40, 3)}
    got = network.linked(spark.createDataFrame(links, "firm string, person string"), spark.createDataFrame([(f,) for f in [*flagged, None, "f0"]], "firm string"), hot)
    firms = {}
    for f, p in links:
        if f and p:
            firms.setdefault(p, set()).add(f)
    want = {}
    for f in {f for f, p in links if f and p}:
        others = set().union(*[s for s in firms.values() if f in s]) - {f}
        if others:
            want[f] = (len(others), len(others & flagged))
    assert {x.firm: (x.linked, x.flagged) for x in got.collect()} == want
