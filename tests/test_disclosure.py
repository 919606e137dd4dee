"""Filing behaviour and contradictions against plain Python over lists."""

import random
import statistics
from datetime import date, timedelta

from tidemark.operators import disclosure as D
from tidemark.operators import ranks

FORMS = ["10-K", "10-K405", "10-K/A", "NT 10-K", "NT 10-Q", "8-K", "8-K/A", "10-Q", "10-Q/A", "4"]


def _shifted(d):
    return d.timetuple().tm_yday + (365 if d.month <= 5 else 0)


def _behaviour(entity, year, links, filings):
    end = date(year, 12, 31)
    own = [x for x in links if x[0] == entity and x[1] is not None]
    if not own:
        return None
    far = lambda x: not ((x[3] or date(1900, 1, 1)) <= end + timedelta(365) and (x[4] or date(2100, 1, 1)) >= end - timedelta(365))
    own.sort(key=lambda x: (far(x), x[2]))
    filed = {}
    for x in own:
        days = [d for f, d, k in filings if f == x[1] and k in D.ANNUAL and date(year, 6, 1) <= d <= date(year + 1, 12, 31)]
        if days:
            filed = {"firm": x[1], "day": min(days)}
            break
    if not filed:
        some = [x for x in own if any(f == x[1] for f, _, _ in filings)]
        return ((some or own)[0][1], *[None] * 9, 1)
    firm, t = filed["firm"], filed["day"]
    past = [(d, k) for f, d, k in filings if f == firm and d <= t]
    median = statistics.median(_shifted(d) for f, d, k in filings if f == firm and k in D.ANNUAL)
    count = lambda days, ok: sum(ok(k) for d, k in past if (t - d).days <= days)
    return (
        firm, _shifted(t), _shifted(t) - median, min(1, count(120, lambda k: k.startswith("NT 10-K"))), count(1095, lambda k: k.startswith("NT 10")), count(1095, lambda k: k in D.ANNUAL_AMENDED),
        count(1095, lambda k: k in D.QUARTERLY_AMENDED), count(365, lambda k: k.startswith("8-K")), count(365, lambda k: True), round((t - min(d for d, _ in past)).days / 365.25, 6), 0,
    )


def test_filing_behaviour(spark):
    r = random.Random(8)
    day = lambda: date(1996, 1, 1) + timedelta(r.randrange(2500))
    filings = list({(f"f{r.randrange(12)}", day(), r.choice(FORMS)) for _ in range(900)})
    filings += [("f1", d, k) for f, d, k in filings if f == "f1"]  # repeats count twice
    links = [(e, f"f{r.randrange(15)}", i, r.choice([None, day()]), r.choice([None, day()])) for e in range(20) for i in range(r.randrange(4))] + [(3, None, 9, None, None), (50, "nothing", 0, None, None)]
    panel = [(e, y) for e in [*range(20), 50, 99] for y in range(1995, 2004)]
    odd = spark.createDataFrame([(None, date(2000, 1, 1), "10-K"), ("f1", None, "10-K"), ("f1", date(2000, 1, 1), None)], "firm string, day date, form string")
    f = spark.createDataFrame(filings, "firm string, day date, form string").union(odd).selectExpr("*", "1 as year", "'x' as entity")
    got = D.filing_behaviour(
        spark.createDataFrame(panel, "entity long, year int").selectExpr("*", "1 as firm", "2 as place"), spark.createDataFrame(links, "entity long, firm string, place int, first date, last date").selectExpr("*"), f
    ).collect()
    plain = [x for x in filings]
    want = {(e, y): w for e, y in panel if (w := _behaviour(e, y, links, plain))}
    assert {(x.entity, x.year): (*x[2:11], None if x.firm_age is None else round(x.firm_age, 6), x.not_found) for x in got} == want and len(got) == len(want)
    assert len({w[0] for w in want.values()}) > 8 and 20 < sum(w[-1] for w in want.values()) < len(want) - 60
    none = spark.createDataFrame([], "firm string, day date, form string")
    assert {x.not_found for x in D.filing_behaviour(spark.createDataFrame(panel, "entity long, year int"), spark.createDataFrame(links, "entity long, firm string, place int, first date, last date"), none).collect()} == {1}


COLUMNS = ["tone", "strong", "growth_claim", "adjusted", "income", "prior_income", "revenue", "prior_revenue", "roa", "loss", "negative_equity", "cash_ratio", "late_days", "not_effective", "adverse", "weaknesses", "going_concern", "corrections", "notices_2y", "letters_1y"]
FLAGS = {"growth_claim", "loss", "negative_equity", "not_effective", "adverse", "going_concern"}


def _contradictions(rows, x):
    if x["tone"] is None:
        return [None] * 14
    both = lambda a, b: None if a is None or b is None else a * b
    less = lambda a: None if a is None else 1 - a
    more = lambda c: float(x[c] is not None and x[c] > 0)

    def fell(now, before, by):
        return float(x[now] is not None and x[before] is not None and (x[now] - x[before]) / max(1, abs(x[before])) < by)

    year = [y for y in rows if y["year"] == x["year"]]
    high = float(x["tone"] > statistics.median(y["tone"] for y in year if y["tone"] is not None))
    ranked = [y for y in year if y["tone"] is not None and y["roa"] is not None]
    gap = None
    if x in ranked and len(ranked) >= 11:
        place = lambda c: sorted(ranked, key=lambda y: (y[c], y["id"])).index(x) / (len(ranked) - 1)
        gap = place("tone") - place("roa")
    e, quiet = less(x["not_effective"]), less(x["going_concern"])
    distressed = float(bool(x["negative_equity"]) and bool(x["loss"]) and x["cash_ratio"] is not None and x["cash_ratio"] < 0.05)
    return [
        x["tone"], high * fell("income", "prior_income", -0.1), both(x["strong"], x["loss"]), both(x["growth_claim"], fell("revenue", "prior_revenue", -0.05)), both(x["adjusted"], x["loss"]), gap, both(e, x["adverse"]),
        *[both(e, more(c)) for c in ("weaknesses", "corrections", "late_days", "notices_2y", "letters_1y")], both(quiet, distressed), both(x["going_concern"], float(x["loss"] == 0 and x["negative_equity"] == 0)),
    ]


def test_contradictions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 15)
    r = random.Random(6)

    def value(c):
        if r.random() < 0.1:
            return None
        return float(r.random() < 0.4) if c in FLAGS else float(r.randrange(-2, 4)) if c in ("late_days", "corrections", "weaknesses", "notices_2y", "letters_1y") else round(r.gauss(0, 1), 1) if c != "cash_ratio" else r.random() / 10

    rows = [{"id": i, "year": r.choice([1, 2, 2, 2, None] if i > 8 else [3])} | {c: value(c) for c in COLUMNS} for i in range(300)]
    schema = "id long, year int, " + ", ".join(f"{c} double" for c in COLUMNS)
    df = spark.createDataFrame([tuple(x[c] for c in ["id", "year", *COLUMNS]) for x in rows], schema).selectExpr("*", "'clash' as effective_but_late")
    got = {x[0]: [None if v is None else round(v, 9) for v in x[1:]] for x in D.contradictions(df, "id", "year").collect()}
    want = {x["id"]: [None if v is None else round(v, 9) for v in _contradictions(rows, x)] for x in rows}
    assert got == want
    assert all(len({w[k] for w in want.values()}) > 2 for k in range(14))
    assert D.contradictions(df.limit(0), "id", "year").count() == 0


def _audit(panel_row, audits, reports):
    _, firm, t = panel_row
    own = sorted((a for a in audits if a[0] == firm and a[0] is not None and a[1] is not None), key=lambda a: (a[1], a[7]))
    now = [a for a in own if 0 <= (t - a[1]).days <= 400]
    if not now:
        return (None,) * 14
    a = now[-1]
    before = [b for b in own if (a[1] - b[1]).days > 300]
    b = before[-1] if before else None
    told = sorted((r for r in reports if r[0] == a[2] and r[0] is not None and r[1] is not None and r[2] is not None and r[1] < t), key=lambda r: (r[1], r[2]))
    last, prior = (told[-1] if told else None), (told[-2][2] if len(told) > 1 else None)
    audits_before = sum(1 for x in audits if x[0] is not None and x[1] and a[2] is not None and x[2] == a[2] and x[1].year == a[1].year - 1)
    return (
        *((last[2], prior, None if prior is None else round(last[2] - prior, 9), *last[3:6], round((t - last[1]).days / 365.25, 9)) if last else (None,) * 7),
        None if a[2] is None else int(not told), None if b is None else int(a[2] != b[2]), None if b is None else int(a[3] != b[3]), a[4] or 0, a[5] or 0.0, None if a[6] is None else (a[6] - a[1]).days, audits_before,
    )


def test_audit_history(spark):
    r = random.Random(9)
    day = lambda: date(2015, 1, 1) + timedelta(r.randrange(2400))
    some = lambda v: None if r.random() < 0.1 else v
    audits = [(some(r.randrange(12)), some(day()), some(r.choice("AAAABCD")), some(r.randrange(3)), some(r.randrange(4)), some(round(r.random(), 3)), some(day()), i) for i in range(160)]
    reports = [(some(r.choice("ABC")), some(day()), some(round(r.random(), 3)), r.randrange(50), r.randrange(50), r.randrange(2)) for _ in range(40)]
    panel = [(i, some(r.randrange(14)), day()) for i in range(400)] + [(400 + i, a[0], a[1] + timedelta(gap)) for i, (a, gap) in enumerate(zip([a for a in audits if a[1]], [0, 400, 401] * 60))]
    p = spark.createDataFrame(panel, "id long, firm long, t date").selectExpr("*", "1 as auditor", "2 as rate")
    a = spark.createDataFrame(audits, "firm long, period_end date, auditor string, partner long, participants long, share double, signed date, form long").selectExpr("*", "'x' as id")
    q = spark.createDataFrame(reports, "auditor string, day date, rate double, reviewed long, clients long, annual long").selectExpr("*", "'x' as t")
    got = D.audit_history(p, a, q).collect()
    told = lambda v: round(v, 9) if isinstance(v, float) else v
    assert len(got) == len(panel)
    assert {x.id: tuple(told(v) for v in x[1:]) for x in got} == {x[0]: _audit(x, audits, reports) for x in panel}
    assert D.audit_history(p, a.limit(0), q.limit(0)).where("rate is null and never is null").count() == len(panel)
