"""Isotonic steps, delay curves, weights, refits and searches against plain versions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import refit


def plain_isotonic(points):
    """Blocks [low, high, n, p] of (score, y) points, equal scores together."""
    by = {}
    for s, y in points:
        n, p = by.get(s, (0, 0))
        by[s] = (n + 1, p + y)
    out = []
    for s, (n, p) in sorted(by.items()):
        out.append([s, s, n, p])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return out


def plain_value(blocks, s):
    pts = [(x, p / n) for low, high, n, p in blocks for x in ((low, high) if low < high else (low,))]
    if s <= pts[0][0]:
        return pts[0][1]
    for (a, u), (b, v) in zip(pts, pts[1:], strict=False):
        if s <= b:
            return u + (v - u) * (s - a) / (b - a)
    return pts[-1][1]


def test_isotonic_by_group(spark):
    """A large group, one with few rows, one with few positives, one not in training, null groups, ties and null scores."""
    r = random.Random(2)
    train = []
    for g, n, rate in (("big", 3000, 1.0), ("mid", 400, 0.6), ("few", 50, 1.0), ("rare", 500, 0.01), (None, 350, 0.9)):
        for _ in range(n):
            s = round(r.random(), 3)
            train.append((g, s, int(r.random() < rate * s * s)))
    train += [("big", None, 1), ("big", 0.5, None)]
    rows = [(i, r.choice(["big", "mid", "few", "rare", "new", None]), None if i % 50 == 3 else r.choice([-1.0, 2.0, round(r.random(), 3), r.random()])) for i in range(600)]
    t = spark.createDataFrame(train, "g string, s double, y int").repartition(3)
    got = {x.i: x.calibrated for x in C.calibrated(t, spark.createDataFrame(rows, "i long, g string, s double"), "g", "s", "y").collect()}
    points = [(g, s, y) for g, s, y in train if s is not None and y is not None]
    every = plain_isotonic([p[1:] for p in points])
    own = {}
    for g in {p[0] for p in points}:
        mine = [p[1:] for p in points if p[0] == g]
        if len(mine) >= 300 and sum(y for _, y in mine) >= 15:
            own[g] = plain_isotonic(mine)
    assert set(own) == {"big", "mid", None}
    for i, g, s in rows:
        want = None if s is None else plain_value(own.get(g, every), s)
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None, (i, g, s)
    blocks = C.isotonic_blocks(t.where("g = 'big'"), "g", "s", "y").collect()
    assert sorted([b.low, b.high, b.n, b.p] for b in blocks) == own["big"]


def test_delay_curve_by_hand(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (4, True), (4, True), (5, False), (-1, True)], "lag int, seen boolean")
    got = {r.lag: (r.at_risk, r.events, round(r.matured, 9)) for r in C.delay_curve(df, "lag", "seen").collect()}
    s1, s2 = 5 / 6, 5 / 6 * 3 / 4
    assert got == {1: (6, 1, round(1 - s1, 9)), 2: (4, 1, round(1 - s2, 9)), 4: (3, 2, round(1 - s2 / 3, 9)), 5: (1, 0, round(1 - s2 / 3, 9))}
    w = C.maturity_weight(spark.createDataFrame([(1, 0, 0), (2, 3, 0), (3, 9, 0), (4, 0, 1)], "k int, e int, y int"), C.delay_curve(df, "lag", "seen"), "e", "y")
    assert {r.k: round(r.weight, 9) for r in w.collect()} == {1: 0.05, 2: round(1 - s2, 9), 3: round(1 - s2 / 3, 9), 4: 1.0}


def test_unlabelled_weights_by_hand(spark):
    df = spark.createDataFrame([(1, 0.8, 1, True), (2, 0.4, 1, True), (3, 0.9, 1, False), (4, 0.3, 0, True), (5, 0.99, 0, False), (6, 0.0, 0, False)], "k int, s double, y int, out boolean")
    got = {r.k: (round(r.prior, 9), round(r.weight, 9)) for r in C.unlabelled_weight(df, "s", "y", F.col("out")).collect()}
    rate = 0.6
    assert got[1] == (round(0.5 / rate, 9), 1.0) and got[4][1] == round(1 - (0.4 / 0.6) * 0.3 / 0.7, 9) and got[5][1] == 0.0 and got[6][1] == 1.0


def test_no_label_after_the_cutoff_reaches_a_score(spark):
    """Events from a cut-off on are moved, removed and added; the scores of that cut-off stay."""
    from tidemark.plans.ensembles import _fit_rolling

    r, rows = random.Random(8), []
    for i in range(400):
        d = date(2000, 1, 1) + timedelta(r.randrange(1400))
        total = r.random() * 10
        rows.append((i, d, total if i % 9 else None, float(r.randrange(3)), d + timedelta(r.randrange(500)) if r.random() < total / 10 else None))
    schema = "o_orderkey long, d date, total double, lines double, event date"
    cut = date(2002, 1, 1)
    changed = [(k, d, t, x, e if e and e < cut else (cut + timedelta(k % 300) if k % 2 and d < cut + timedelta(400) else None)) for k, d, t, x, e in rows]
    assert sum(a != b for a, b in zip(rows, changed, strict=True)) > 50
    score = lambda data: {x.o_orderkey: x.score for x in refit.rolling(spark.createDataFrame(data, schema), "d", "event", ["2001-01-01", "2002-01-01", "2003-01-01"], _fit_rolling).collect()}
    a, b = score(rows), score(changed)
    early = [k for k, d, *_ in rows if date(2001, 1, 1) <= d < date(2003, 1, 1)]
    assert set(a) == set(early) and all(a[k] == pytest.approx(b[k]) for k in early) and len(set(a.values())) > 50


def test_rolling_works_out_its_rows_once(spark):
    """However many cut-offs and passes of fits there are; rows from the last cut-off on are left out."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    data = [(i, date(2000, 1, 1) + timedelta(i * 10), float(i % 7), date(2000, 2, 1) + timedelta(i * 10) if i % 3 else None) for i in range(150)]
    df = spark.createDataFrame(data, "k long, d date, x double, event date")
    fit = lambda train, rows: rows.withColumn("score", F.lit(train.agg(F.avg("y")).first()[0]) + F.col("x") * train.count()).select("k", "score")
    got = refit.rolling(df.mapInPandas(count, df.schema), "d", "event", ["2001-01-01", "2002-01-01", "2003-01-01"], fit).collect()
    assert seen.value == len(data)

    def score(i, cut):
        past = [e is not None and e < cut for _, d, _, e in data if d < cut]
        return sum(past) / len(past) + data[i][2] * len(past)

    cuts = [date(2001, 1, 1), date(2002, 1, 1), date(2003, 1, 1)]
    want = {(i, str(a)): score(i, a) for a, b in zip(cuts, cuts[1:], strict=False) for i, d, *_ in data if a <= d < b}
    assert {(r.k, r.cutoff): r.score for r in got} == pytest.approx(want) and len(got) == len(want)


def test_search_is_seeded_and_finds_the_plain_winner(spark):
    space = {"shift": [0, 1, 2, 3], "sign": [1, -1]}
    assert refit.parameter_table(space, 5, 3) == refit.parameter_table(space, 5, 3) != refit.parameter_table(space, 5, 4)
    assert len(refit.parameter_table(space, 99, 1)) == 8
    df = spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y"))
    fit = lambda train, valid, seed, shift, sign: valid.withColumn("score", (F.col("y") * sign * shift + seed).cast("double"))
    metric = lambda s: s.agg(F.sum(F.when(F.col("y") == 1, F.col("score"))) - F.sum(F.when(F.col("y") == 0, F.col("score")))).first()[0]
    got = refit.search(df, df, space, 6, 3, [1, 2], fit, metric)
    want = max(refit.parameter_table(space, 6, 3), key=lambda p: p["shift"] * p["sign"])
    assert {k: got[0][k] for k in space} == want and got[0]["metric"] == 25 * want["shift"] * want["sign"]
