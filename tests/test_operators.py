"""Boundaries, ties, nulls and empty groups on small frames worked out by hand."""

import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.operators import facts, metrics, models, portfolio, sequence, temporal
from tidemark.sources import readers, writers
from tidemark.streaming import windows

T0 = date(2020, 6, 30)


def days(*back):
    return [T0 - timedelta(days=b) for b in back]


def test_past_windows_count_each_boundary_day(spark):
    panel = spark.createDataFrame([(1, "e", T0), (2, "none", T0)], "id long, k string, t date")
    events = spark.createDataFrame([("e", d) for d in days(-1, 0, 1, 90, 91, 364, 365, 366, 1095, 1096)] + [(None, T0)], "k string, d date")
    w = {"year": (1, 365), "three": (1, 1095), "closed": (0, 365), "next": (-3, 0)}
    got = {r.id: r for r in temporal.past_counts(panel, events, "k", "t", "d", w).collect()}
    assert (got[1].year, got[1].three, got[1].closed, got[1].next) == (5, 7, 6, 2)
    assert (got[2].year, got[2].three, got[2].closed, got[2].next) == (0, 0, 0, 0)
    since = {r.id: r.days_since for r in temporal.days_since_last(panel, events, "k", "t", "d", 3650).collect()}
    assert since == {1: 1, 2: 3650}


def test_nothing_from_t_on_changes_the_past(spark):
    panel = spark.createDataFrame([(1, "e", T0)], "id long, k string, t date")
    events = spark.createDataFrame([("e", d) for d in days(5, 50)], "k string, d date")
    later = events.union(spark.createDataFrame([("e", d) for d in days(0, -1, -400)], "k string, d date"))
    w = {"n": (1, 365)}
    assert temporal.past_counts(panel, events, "k", "t", "d", w).collect() == temporal.past_counts(panel, later, "k", "t", "d", w).collect()
    label = lambda e: temporal.label_within(panel, e, "k", "t", "d", 1095).first().label
    assert (label(events), label(later)) == (0, 1)


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "id long, k string, t date")
    right = spark.createDataFrame([("a", d, i) for i, d in enumerate(days(500, 100, 0, -1))], "k string, d date, v long")
    take = lambda df: {r.id: r.v for r in df.collect()}
    assert take(temporal.asof_backward(left, right, "k", "t", "d", ["v"])) == {1: 1, 2: None}
    assert take(temporal.asof_backward(left, right, "k", "t", "d", ["v"], strict=False)) == {1: 2, 2: None}
    assert take(temporal.asof_backward(left, right, "k", "t", "d", ["v"], tolerance=99)) == {1: None, 2: None}
    assert take(temporal.asof_backward(left, right, "k", "t", "d", ["v"], tolerance=100)) == {1: 1, 2: None}
    assert take(temporal.asof_forward(left, right.where("v <> 2"), "k", "t", "d", ["v"], 1)) == {1: 3, 2: None}
    assert take(temporal.asof_forward(left, right.where("v <> 2"), "k", "t", "d", ["v"], 0)) == {1: None, 2: None}


def test_within_meets_all_pairs_of_the_window(spark):
    left = spark.createDataFrame([(i, i % 3, T0 + timedelta(days=i * 7)) for i in range(40)], "id long, k long, t date")
    right = spark.createDataFrame([(i % 3, T0 + timedelta(days=i * 5), i) for i in range(60)], "k long, d date, j long")
    got = sorted((r.id, r.j) for r in temporal.within(left, right, "k", "t", "d", -10, 25).collect())
    want = sorted((a.id, b.j) for a in left.collect() for b in right.collect() if a.k == b.k and -10 <= (b.d - a.t).days <= 25)
    assert got == want


@pytest.mark.parametrize(("gap", "ok"), [(299, False), (300, True), (430, True), (431, False)])
def test_previous_row_within_a_gap(spark, gap, ok):
    df = spark.createDataFrame([("k", T0, 1), ("k", T0 + timedelta(days=gap), 2)], "k string, d date, v long")
    got = temporal.previous(df, "k", ["d"], ["v"], "d", (300, 430)).orderBy("d").collect()
    assert [r.prev_v for r in got] == [None, 1 if ok else None]


def test_priority_pick_settles_ties(spark):
    f = spark.createDataFrame([("a", "c", 1, 5, 10.0), ("a", "c", 0, 9, 20.0), ("a", "c", 0, 7, 30.0), ("b", "c", 2, 1, None)], "k string, c string, rank int, line int, v double")
    assert {r.k: r.v for r in facts.priority_pick(f, ["k", "c"], "rank", "line", "v").collect()} == {"a": 30.0, "b": None}


def test_ranks_and_cuts(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0, 5.0])], "i long, v double").withColumn("g", F.lit(1))
    assert [r.p for r in df.select("i", sequence.rank_pct("v", ["g"]).alias("p")).orderBy("i").collect()] == [0.8, 0.3, 0.3, 0.6, 1.0]
    assert [r.u for r in df.select("i", sequence.rank_unit(["g"], "v", "i").alias("u")).orderBy("i").collect()] == [0.75, 0.0, 0.25, 0.5, 1.0]
    assert [r.q for r in df.select("i", sequence.quantile_cut(["g"], "v", "i", 4).alias("q")).orderBy("i").collect()] == [3, 1, 1, 2, 4]


def test_smoothing_is_the_recursion(spark):
    xs = [5.0, 1.0, 4.0, 4.0, 9.0, 2.0] * 30
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i long, v double")
    want, last = [], None
    for x in xs:
        last = x if last is None else (x + 0.5 * last) / 1.5
        want.append(last)
    assert [r.smooth for r in sequence.smoothed(df, ["k"], "i", "v", 0.5).orderBy("i").collect()] == pytest.approx(want)


def test_auc_against_all_pairs(spark):
    rows = [(float(i * 7 % 13 // 2), int(i % 3 == 0), i) for i in range(60)] + [(None, 1, 99), (1.0, None, 98)]
    df = spark.createDataFrame(rows, "s double, y int, i long")
    pos, neg = [s for s, y, _ in rows if y == 1 and s is not None], [s for s, y, _ in rows if y == 0]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(want)
    assert metrics.auc(df.where("y = 1"), "s", "y").first().auc is None
    boot = metrics.bootstrap_auc(df.where("s is not null and y is not null"), ["s"], "y", "i", 40)
    assert boot.count() == 40 and sorted(map(tuple, boot.collect())) == sorted(map(tuple, metrics.bootstrap_auc(df.where("s is not null and y is not null").repartition(3), ["s"], "y", "i", 40).collect()))


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20_000).select(metrics.poisson_weight(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert w.m == pytest.approx(1, abs=0.03) and w.v == pytest.approx(1, abs=0.06)


def test_ols_with_lagged_errors(spark):
    import numpy as np

    x = np.array([1, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10, 13], float)
    y = 2 + 0.5 * x + np.array([0.3, 0.2, 0.1, -0.2, -0.3, -0.1, 0.2, 0.3, 0.1, -0.1, -0.3, -0.2])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double")
    _, beta, se = models.ols(df, "y", ["x"], ["t"], 3)
    X = np.column_stack([np.ones(12), x])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    g = X * (y - X @ b)[:, None]
    meat = g.T @ g + sum((1 - l / 4) * (g[l:].T @ g[:-l] + g[:-l].T @ g[l:]) for l in (1, 2, 3))
    inv = np.linalg.inv(X.T @ X)
    assert beta == pytest.approx(b) and se == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)))


def test_imputation_uses_training_medians_only(spark):
    df = spark.createDataFrame([(1, 1.0, None, True), (2, 3.0, None, True), (3, None, None, False), (4, 99.0, 7.0, False)], "i long, a double, b double, train boolean")
    got = {r.i: (r.a, r.b, r.a_missing) for r in models.impute_median(df, ["a", "b"], F.col("train"), 1).collect()}
    assert got == {1: (1.0, 0.0, 0.0), 2: (3.0, 0.0, 0.0), 3: (2.0, 0.0, 1.0), 4: (99.0, 7.0, 0.0)}


def test_panel_screens_and_delisting(spark):
    rows = [("ok", 1, 10.0), ("ok", 2, 11.0), ("ok", 3, 12.0), ("jump", 1, 1.0), ("jump", 2, 20.0), ("ends", 1, 10.0), ("ends", 2, 9.0), ("ok", 20, 12.0)]
    df = spark.createDataFrame([(k, date(2020, 1, d), v, d) for k, d, v in rows], "k string, d date, v double, o int")
    got = {(r.k, r.p.day): r for r in portfolio.panel(df, "k", F.col("d"), "v", ["o"], 10, 0.01, 1e5, 7, 0.3).collect()}
    assert {k for k, _ in got} == {"ok", "ends"}
    assert got["ends", 2].ret == pytest.approx(0.9 * 0.7 - 1) and got["ok", 1].nxt == pytest.approx(0.1) and got["ok", 3].nxt == 0


def test_scalars_keep_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (-8.0, 2.0), (300.0, 2.0)], "a double, b double")
    got = df.select(scalar.safe_ratio(F.col("a"), F.col("b")), scalar.abs_ratio(F.col("a"), F.col("b")), scalar.clip(F.col("a"), -2, 2), scalar.signed_exp(scalar.signed_log(F.col("a")))).collect()
    assert [tuple(r)[:3] for r in got] == [(None, None, 1.0), (None, None, None), (-4.0, -4.0, -2.0), (None, 150.0, 2.0)]
    assert [r[3] for r in got] == [pytest.approx(1.0), None, pytest.approx(-8.0), pytest.approx(300.0)]
    dates = spark.createDataFrame([("20200229",), ("2020-02-29",), ("29-Feb-2020",), ("February 29 2020",), ("20210229",), (None,)], "s string")
    assert [r[0] for r in dates.select(scalar.parse_date(F.col("s"))).collect()] == [date(2020, 2, 29)] * 4 + [None, None]


def test_text_functions(spark):
    doc = "Item 9A. Controls were not effective. See Item 9A for more. Item 8. Notes. There is substantial doubt about going concern."
    df = spark.createDataFrame([(doc,), ("",), (None,)], "t string")
    cut = text.cut_sections({"9A": r"Item 9A\.?", "8": r"Item 8\."})
    got = [r.s for r in df.select(cut("t").alias("s")).collect()]
    assert got[0]["9A"].startswith("Item 9A. Controls") and "for more" in got[0]["9A"] and got[0]["8"].startswith("Item 8. Notes") and got[1] == {} == got[2]
    f = df.select(*[v.alias(k) for k, v in text.flags(F.col("t"), text.DISCLOSURE).items()]).collect()
    assert (f[0].not_effective, f[0].going_concern, f[0].big4) == (1, 1, 0) and f[2].not_effective == 0
    table = "Audit Fees $ 1,200 $ 1,100 Audit-Related Fees 50,000 Tax Fees — All Other Fees 10,000 (in thousands)"
    read = [r.f for r in spark.createDataFrame([(1, table), (2, "none here")], "i int, t string").orderBy("i").select(text.fees(F.col("t")).alias("f")).collect()]
    assert (read[0].audit, read[0].total) == (1_200_000.0, 61_200_000.0) and read[1] is None


def test_readers_and_writers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "2020q1.zip", "w") as z:
        z.writestr("num.txt", "adsh\tvalue\na\t1.5\nb\tx\n")
    got = readers.read_zipped(spark, f"{tmp_path}/*.zip", "num.txt", "adsh string, value double").collect()
    assert [(r.adsh, r.value) for r in got] == [("a", 1.5), ("b", None)]
    (tmp_path / "log.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted(r.k for r in readers.read_json_lines(spark, f"{tmp_path}/log.jsonl", "k long").collect()) == [1, 2]
    (tmp_path / "form.idx").write_text("title\n-----\n10-K  Acme Inc  77  2020-01-02  x\n")
    rows = readers.read_matching_rows(spark, f"{tmp_path}/form.idx", r"^(\S+)\s+.*\s(\d+)\s+(\d{4}-\d{2}-\d{2})", {"form": 1, "cik": 2, "day": 3}).collect()
    assert [tuple(r) for r in rows] == [("10-K", "77", "2020-01-02")]
    block = spark.createDataFrame([("b", 1), ("a", None)], "adsh string, x int")
    writers.write_block(block, f"{tmp_path}/block", "adsh")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/block").collect()), key=str) == [("a", None), ("b", 1.0)]
    assert writers.markdown(writers.top_report(block, [F.asc("adsh")], 1)).splitlines()[-1] == "| a |  | 1 |"


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("user_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    events.where("user_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.run_available(windows.tumbling(stream, "ts", "1 day", ["event_type"], "value", "60 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    windows.run_available(windows.once(stream.unionByName(stream), "ts", "event_id", "60 days").select("event_id"), f"{tmp_path}/once", f"{tmp_path}/ck1")
    assert spark.read.parquet(f"{tmp_path}/once").count() == events.count()
    late = windows.tumbling(events, "ts", "1 day", ["event_type"], "value").count()
    assert 0 <= spark.read.parquet(f"{tmp_path}/out").count() <= late  # windows still open at the end are not written
    part = stream.select("user_id", "event_id", "value")
    windows.run_available(windows.smoothed_stream(part, "user_id", "event_id", "value", 0.5), f"{tmp_path}/sm", f"{tmp_path}/ck2")
    batch = sequence.smoothed(events, ["user_id"], "event_id", "value", 0.5).select("event_id", "smooth")
    pairs = spark.read.parquet(f"{tmp_path}/sm").withColumnRenamed("smooth", "s2").join(batch, "event_id")
    assert pairs.count() == events.count() and pairs.where("abs(smooth - s2) > 1e-6").count() == 0


def test_fee_tables(spark):
    """The best of several tables, prior years, dashes, thousands, years that are no amounts, captions without amounts."""
    from tidemark.functions import text as X

    texts = [
        "Audit fees were 2001 policy. Audit Fees $ 1,200 $1,100 Audit-Related Fees — 50,000 Tax Fees 300 400 All Other Fees nil Total Fees $ 51,700",
        "x (in thousands) audit fees (1) $ (950) 870 tax fees 12 total 1,000 900", None, "", "no fees", "Audit fees 2001 2000", "Audit fees $5 Audit fees $7 Tax fees $8", "audit fees 9,999,999,999", "tax fees $ 7",
    ]
    got = {r.i: r.f and tuple(r.f) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fees(F.col("t")).alias("f")).collect()}
    assert got[0] == (1200.0, 0.0, 300.0, 0.0, 51700.0, 1100.0, 50000.0, 400.0, None, 51500.0)
    assert got[1] == (950000.0, None, None, None, 1000000.0, 870000.0, None, None, None, 900000.0)
    assert got[6] == (7.0, None, 8.0, None, 15.0, None, None, None, None, None)
    assert [got[i] for i in (2, 3, 4, 5, 7, 8)] == [None] * 6


def test_text_flags_both_ways(spark):
    """A sentence that each pattern finds, and near misses that none does."""
    from tidemark.functions import text as X

    hits = {
        "not_effective": "disclosure controls and procedures were not effective", "remediation": "we remediated it", "going_concern": "substantial doubt about its going concern", "big4": "audited by KPMG",
        "adverse": "an adverse opinion on internal control", "class_action": "a putative class action", "investigation": "the SEC began an investigation", "mw_revenue": "a material weakness in revenue",
        "mw_itgc": "ITGC", "mw_segregation": "segregation of duties", "mw_close": "the period-end financial reporting process", "mw_staff": "lack of accounting personnel", "mw_nonroutine": "complex transactions",
        "mw_tax": "a material weakness in income tax", "mw_override": "management override", "cam": "a critical audit matter", "emphasis": "emphasis of matter", "out_of_period": "an out-of-period item", "restated": "as restated",
        "whistleblower": "a whistle-blower", "derivative_suit": "a derivative lawsuit", "reverse_split": "a reverse stock split", "shell": "a shell company", "growth_company": "an emerging growth company", "non_gaap": "adjusted EBITDA",
    }
    patterns = {**X.DISCLOSURE, **X.WEAKNESS}
    assert set(hits) == set(patterns)
    misses = "controls were effective. A weak opinion, an action of the class, understated doubts, periods and taxes, a split, growth, duties, override"
    rows = [(k, v) for k, v in hits.items()] + [("none", misses), ("null", None)]
    for r in spark.createDataFrame(rows, "k string, t string").select("k", *[v.alias(n) for n, v in X.flags(F.col("t"), patterns).items()]).collect():
        found = {n for n in patterns if r[n]}
        assert (r.k in found) if r.k in hits else not found, (r.k, found)


def test_percentiles_and_ranks_over_ranges(spark):
    """Against sorted lists, by group and over all, with ties, a group with a third of the rows, single values and nulls."""
    import random

    from tidemark.operators import metrics as M

    r = random.Random(3)
    rows = [("hot" if i % 3 == 0 else r.choice(["a", "b", None]), r.choice([r.random(), round(r.random(), 1), 0.5, None]), int(r.random() < 0.3)) for i in range(3000)] + [("one", 7.0, 1), ("empty", None, 0)]
    df = spark.createDataFrame(rows, "g string, v double, y int").repartition(7)
    at = [0.0, 0.1, 0.5, 0.975, 1.0]

    def exact(values, q):
        s = sorted(values)
        k = q * (len(s) - 1)
        low = int(k)
        return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (k - low)

    got = {x.g: tuple(x)[1:] for x in M.percentiles(df, "v", at, ["g"]).collect()}
    by = {}
    for g, v, _ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert got.keys() == by.keys()
    for g, values in by.items():
        assert got[g] == pytest.approx([exact(values, q) for q in at])
    assert tuple(M.percentiles(df, "v", at).first()) == pytest.approx([exact([v for vs in by.values() for v in vs], q) for q in at])
    for x in M.ranked_counts(df, "v", "y", ["g"]).collect():
        mine = [(v, y) for g, v, y in rows if g == x.g and v is not None]
        assert (x.below, x.below_neg) == (sum(v < x.v for v, _ in mine), sum(v < x.v and y == 0 for v, y in mine))


def test_rounds_open_after_a_gap(spark):
    rows = [(i, k, d) for i, (k, d) in enumerate([("a", T0), ("a", T0), ("a", T0 + timedelta(days=90)), ("a", T0 + timedelta(days=181)), ("b", T0 + timedelta(days=1)), ("c", None)])]
    events = spark.createDataFrame(rows, "id long, k string, d date")
    got = {r.id: r.opens for r in temporal.rounds(events, "k", "d", 90).collect()}
    assert got[0] + got[1] == 1 and [got[i] for i in (2, 3, 4, 5)] == [False, True, True, True]


def test_term_weights_by_hand(spark):
    """Words and pairs, a cap that binds with a tie, and documents without any term."""
    import math
    from collections import Counter

    from tidemark.operators import terms

    texts = ["Aa bb aa", "bb cc", "aa bb cc dd", "dd x é", None, "", "dd cc bb"]
    bags = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in ([x for x in (t or "").lower().split() if len(x) > 1] for t in texts)]
    df = Counter(t for b in bags for t in b)
    tf = sum(bags, Counter())
    for cap in (3, 4, 100):
        vocab = sorted((t for t in df if 2 <= df[t] <= 0.55 * len(texts)), key=lambda t: (-tf[t], t))[:cap]
        want = {}
        for i, b in enumerate(bags):
            s = {t: (1 + math.log(b[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in b if t in vocab}
            if s:
                want[i] = {t: v / math.sqrt(sum(x * x for x in s.values())) for t, v in s.items()}
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = {r.id: {e.term: e.weight for e in r.terms} for r in terms.tfidf(docs, "id", "text", 2, 0.55, cap).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
        assert len({t for v in want.values() for t in v}) == min(cap, len(vocab))


def test_measures_of_texts_by_hand(spark):
    texts = ["Could  it be? The co-ordinate lawsuit could could\nmay not be. I it's 12 Estimate the Risk Factors of a. Unresolved Staff Comments", None, "", "12 - x", "a" * 300_000 + " could " * 100_000, "-" * 400_000]
    x = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    r = {row.id: row for row in x.select("id", *[c.alias(k) for k, c in text.measures(F.col("text")).items()]).collect()}
    # could it be the co-ordinate lawsuit could could may not be it's estimate the risk factors of unresolved staff comments
    assert r[0].n_words == 20 and r[0].avg_sentence == 20 / 3 and r[0].unique_ratio == 16 / 20
    # co-ordinate has o, o, i, a and a silent e; estimate e, i, a; unresolved u, e, o, e.
    assert r[0].pct_complex == 3 / 20 and r[0].uncertain_rate == 6 / 20 and r[0].modal_weak_rate == 4 / 20 and r[0].litigious_rate == 1 / 20
    flat = " ".join(texts[0].split()).lower()
    assert r[0].section_share == pytest.approx((flat.index("unresolved") - flat.index("risk factors")) / len(flat)) and r[0].number_density == pytest.approx(2 / len(flat))
    for i in (1, 2, 3, 5):
        assert (r[i].n_words, r[i].fog, r[i].uncertain_rate, r[i].unique_ratio, r[i].section_share) == (0, None, None, None, 0.0)
    assert r[4].n_words == 100_001 and r[4].modal_weak_rate == 100_000 / 100_001


def test_metric_without_each_group_and_on_new_entities(spark):
    rows = [("a", 1.0, 0), ("a", 2.0, 1), ("b", 2.0, 0), ("b", 1.0, 1), (None, 3.0, 1), ("c", None, 1), ("a", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.left_out: (r.n, r.pos, r.auc) for r in metrics.auc_without(df, "s", "y", "g").collect()}
    # Without a: 1 and 3 against 2; without b: 2 and 3 against 1; without c: 2, 1, 3 against 1, 2.
    assert got == {"a": (3, 2, 0.5), "b": (3, 2, 1.0), "c": (5, 3, pytest.approx((1.5 + 0.5 + 2) / 6))}
    train = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("b", 1.0, 0), ("d", 1.0, None), (None, 1.0, 1)], "g string, s double, y int")
    new = {r.subset: (r.n, r.pos, r.auc) for r in metrics.auc_of_new(train, df, "s", "y", "g").collect()}
    assert new == {"all": (5, 3, pytest.approx(4 / 6)), "no_positive": (3, 2, 0.5), "new": (1, 1, None)}


def test_dates_try_one_format_only(spark):
    """The same dates as the first of four formats that fits; a text that is another format's is not tried with the others, which costs an exception each."""
    odd = ["20200229", "2020-02-29", "29-Feb-2020", "February 29 2020", "february 29 2020", "20200230", "2020-2-9", "9-feb-2020", "-2020-01-01", "+20200101", " 20200101", "Feb 1 2020", "January 1 1990 ", "", "x", "-", "1", "12-31-1999", None]
    first = lambda c: F.coalesce(*[F.try_to_date(c, f) for f in ("yyyyMMdd", "yyyy-MM-dd", "dd-MMM-yyyy", "MMMM d yyyy")])
    df = spark.createDataFrame([(x,) for x in odd], "s string")
    got = df.select(scalar.parse_date(F.col("s")).cast("string"), first(F.col("s")).cast("string")).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and sum(r[0] is not None for r in got) >= 5
    many = spark.range(0, 200_000, 1, 8).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 9000).cast("int")), "MMMM d yyyy").alias("s"))

    def seconds(column):
        began = time.time()
        many.agg(F.max(column)).collect()
        return time.time() - began

    assert min(seconds(scalar.parse_date(F.col("s"))) for _ in range(3)) < 0.6 * min(seconds(first(F.col("s"))) for _ in range(3))
