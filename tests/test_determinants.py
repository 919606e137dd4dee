"""Determinants of a filing by hand: what is missing, zero, negative or out of bounds."""

from datetime import date

from tidemark.operators import facts

ITEMS = "assets double, restructuring double, deferred double, pretax double, foreign double, current_tax double, allowance double, prior_allowance double"


def test_determinants(spark):
    filings = [(1, 7, date(2020, 1, 1)), (2, 7, date(2021, 1, 1)), (3, 8, date(2020, 6, 1)), (4, None, None), (5, 9, date(2020, 1, 1))]
    values = [(1, 100.0, None, 5.0, -10.0, 50.0, 2.1, 8.0, 3.0), (2, 200.0, 0.0, None, 0.0, 1.0, None, 0.0, None), (3, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (5, 10.0, -2.0, 0.0, 4.0, -1.0, 0.0, None, 1.0)]
    parts = [(1, "seg=a;geo=x"), (1, "seg=a;geo=y"), (1, "seg=b"), (1, None), (2, ""), (3, "other=seg=a"), (99, "seg=z")]
    got = {
        r.id: tuple(None if v is None else round(v, 6) for v in r[1:])
        for r in facts.determinants(
            spark.createDataFrame(filings, "id long, firm long, filed date").selectExpr("*", "1 as assets"), spark.createDataFrame(values, f"id long, {ITEMS}"), spark.createDataFrame(parts, "id long, parts string"),
            spark.createDataFrame([(7, date(2010, 1, 1)), (7, date(2012, 1, 1)), (8, None)], "firm long, day date"), "seg=", "geo=",
        ).collect()
    }
    assert got[1] == (round(3652 / 365.25, 6), 2, 2, 0.0, 0.05, 2.0, -0.2, 0.05, 1, 0, 1)
    assert got[2] == (round(4018 / 365.25, 6), 0, 0, 0.0, None, None, None, None, 1, 0, 0)
    assert got[3] == (None, 0, 0, *[None] * 8)
    assert got[4] == (None, 0, 0, *[None] * 8)
    assert got[5] == (None, 0, 0, -0.2, 0.0, -0.25, 0.4, None, 1, 1, 0)
    assert len(got) == 5
