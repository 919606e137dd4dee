"""Steps that cost a row of a large group no more than one of a small group: no frame looks ahead, no group has a call of its own."""

import math
import random
from datetime import date, timedelta

from tidemark.operators import calibration
from tidemark.operators import temporal as T
from tidemark.plans import registered


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _looks_ahead(df):
    return "RangeFrame, currentrow" in _plan(df)


def test_asof_forward_by_hand(spark):
    r = random.Random(5)
    at = lambda n: date(2020, 1, 1) + timedelta(days=n)
    left = [(i, r.choice("abc"), r.randrange(120)) for i in range(200)] + [(200, "none", 5), (201, None, 5)]
    right = [(r.choice("abc"), r.randrange(120), r.random()) for _ in range(40)]
    want = {}
    for i, k, d in left:
        near = [(e, v) for key, e, v in right if key == k and d <= e <= d + 7]
        want[i] = min(near) if near else None
    a = spark.createDataFrame([(i, k, at(d)) for i, k, d in left], "id long, k string, t date")
    b = spark.createDataFrame([(k, at(d), v) for k, d, v in right], "k string, day date, v double")
    out = T.asof_forward(a, b, "k", "t", "day", ["v"], 7)
    got = {x.id: ((x._day - at(0)).days, x.v) if x._day else None for x in out.collect()}
    assert got == want and not _looks_ahead(out)


def test_calibrated_rows_look_back_only(spark):
    r = random.Random(2)
    train = spark.createDataFrame([("g", s := r.random(), int(r.random() < s)) for _ in range(2000)], "grp string, s double, y int")
    out = calibration.calibrated(train, spark.createDataFrame([("g", i / 20, 0) for i in range(-2, 24)], "grp string, s double, y int"), "grp", "s", "y")
    got = [x.calibrated for x in out.orderBy("s").collect()]
    assert got == sorted(got) and got[0] == got[1] and got[-1] > 0.8 and not _looks_ahead(out)


def test_udaf_has_no_call_for_each_group(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 37, 1 + 1000 * r.random()) for i in range(500)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    out = registered("QUERIES")["udaf_grouped"](spark, str(tmp_path))
    want = {k: round(math.exp(sum(math.log(v) for c, v in rows if c == k) / sum(c == k for c, _ in rows)), 4) for k in range(37)}
    got = {x.o_custkey: x.gmean for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-4 for k in want) and "FlatMapGroupsInPandas" not in _plan(out)
