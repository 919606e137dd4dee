"""Tree ensembles, calibration by group, weights for missing labels, rolling refits and searches. Rows are orders with a late flag."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calibration, metrics, models, refit, trees
from tidemark.plans.learning import _auc, _orders, _train
from tidemark.plans.registry import Registry, n, r6

R = Registry()
_X = ["total", "age", "lines"]


def _binned(t):
    """Orders with nulls as they are, in bins whose cut points come from the training rows; the training rows, written once."""
    df = _orders(t)
    cuts = trees.cut_points(df.where(_train()), _X, 16)
    rows = trees.binned(df, _X, cuts, "o_orderkey", "y")
    return rows, rows.where(_train()).select("h", "x", "y").cache()


@R.query("forest_per_tree")
def forest_per_tree(t):
    """Each tree draws its own negatives."""
    rows, train = _binned(t)
    return _auc(trees.scored(rows, [trees.forest(train, 10, 1.0, 4, 5, 2, bins=16)]))


@R.query("boosted_missing")
def boosted_missing(t):
    """Missing values take a side of their own at each split."""
    rows, train = _binned(t)
    return _auc(trees.scored(rows, [trees.boosted(train, 4, 0.3, 3, bins=16)]))


@R.query("rusboost")
def rusboost(t):
    rows, train = _binned(t)
    return _auc(trees.scored(rows, [trees.rusboost(train, 3, 1.0, 2, bins=16)]))


@R.query("easy_ensemble")
def easy_ensemble(t):
    rows, train = _binned(t)
    return _auc(trees.scored(rows, trees.easy_ensemble(train, 3, 2, 1.0, 2, bins=16)))


@R.query("calibration_by_group")
def calibration_by_group(t):
    """Rates of late orders by price, with steps of their own for priorities that have the support."""
    o = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderdate").cast("date").alias("d"))
    c = calibration.calibrated(o.where(_train()), o.where(~_train()), "o_orderpriority", "score", "y")
    return c.select("o_orderkey", r6("calibrated").alias("calibrated"))


_LAGS = """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS nxt FROM orders),
    c AS (SELECT * FROM o WHERE d < DATE '1999-01-01'), l AS (SELECT o_orderkey, d, coalesce(nxt < DATE '1999-01-01', false) AS seen, CASE WHEN nxt < DATE '1999-01-01' THEN nxt - d ELSE DATE '1999-01-01' - d END AS lag FROM c),
    b AS (SELECT lag, count(*) AS n, sum(seen::INT) AS events FROM l GROUP BY lag), r AS (SELECT lag, events, sum(n) OVER (ORDER BY lag DESC) AS at_risk FROM b),
    k AS (SELECT lag, at_risk, events, 1 - product(1 - events / at_risk) OVER (ORDER BY lag) AS matured FROM r)"""


def _lags(t):
    cut = F.lit("1999-01-01").cast("date")
    d = F.col("o_orderdate").cast("date")
    o = t.orders.select("o_orderkey", d.alias("d"), F.lead(d).over(Window.partitionBy("o_custkey").orderBy(d, "o_orderkey")).alias("next")).where(F.col("d") < cut)
    seen = F.coalesce(F.col("next") < cut, F.lit(False))
    return o.select("o_orderkey", "d", seen.alias("seen"), F.when(seen, F.datediff("next", "d")).otherwise(F.datediff(cut, "d")).alias("lag"))


@R.query("delay_curve", f"{_LAGS} SELECT lag::BIGINT AS lag, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(matured, 6) AS matured FROM k")
def delay_curve(t):
    """How soon a customer's next order is known, with those censored at a cut-off."""
    return calibration.delay_curve(_lags(t), "lag", "seen").select(n("lag").alias("lag"), n("at_risk").alias("at_risk"), n("events").alias("events"), r6("matured").alias("matured"))


@R.query("maturity_weights", f"{_LAGS} SELECT o_orderkey, round(CASE WHEN seen THEN 1.0 ELSE greatest(0.05, coalesce((SELECT max(matured) FROM k WHERE k.lag <= DATE '1999-01-01' - l.d), 0)) END, 6) AS weight FROM l")
def maturity_weights(t):
    """Orders without a next one weigh what share of next orders would be known by now."""
    lags = _lags(t)
    elapsed = F.datediff(F.lit("1999-01-01").cast("date"), F.col("d"))
    df = lags.withColumns({"y": F.col("seen").cast("int"), "elapsed": elapsed})
    return calibration.maturity_weight(df, calibration.delay_curve(lags, "lag", "seen"), "elapsed", "y").select("o_orderkey", r6("weight").alias("weight"))


@R.query(
    "unlabelled_weights",
    """WITH o AS (SELECT o_orderkey, (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)::INT AS y, least(0.99, o_totalprice / 500000) AS s FROM orders), c AS (SELECT avg(CASE WHEN y = 1 AND o_orderkey % 5 = 0 THEN s END) AS c, avg(y::DOUBLE) AS p FROM o)
    SELECT o_orderkey, round(least(1.0, p / c), 6) AS prior, round(CASE WHEN y = 1 THEN 1.0 ELSE 1 - least(1.0, (1 - c) * s / (c * (1 - s))) END, 6) AS weight FROM o, c""",
)
def unlabelled_weights(t):
    k = F.col("o_orderkey")
    o = t.orders.select("o_orderkey", ((F.col("o_orderstatus") == "F") & (k % 3 != 0)).cast("int").alias("y"), F.least(F.lit(0.99), F.col("o_totalprice") / 500000).alias("s"))
    w = calibration.unlabelled_weight(o, "s", "y", k % 5 == 0)
    return w.select("o_orderkey", r6("prior").alias("prior"), r6("weight").alias("weight"))


def _fit_rolling(train, rows):
    features = ["total", "lines"]
    both = models.impute_median(train.withColumn("_t", F.lit(True)).unionByName(rows.withColumns({"_t": F.lit(False), "y": F.lit(None).cast("int")})), features, F.col("_t"), 2)
    return models.logistic(both.where("_t"), both.where("not _t"), features, "y").select("o_orderkey", "score")


@R.query("rolling_refit")
def rolling_refit(t):
    """Orders of three years scored by models that know what was shipped late before each year."""
    o = _orders(t)
    late = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("last"))
    o = o.join(late, "o_orderkey").withColumn("event", F.when(F.datediff("last", "d") > 90, F.col("last"))).drop("y", "last")
    got = refit.rolling(o.select("o_orderkey", "d", "event", "total", "lines"), "d", "event", ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01"], _fit_rolling)
    return got.select("o_orderkey", "cutoff", r6("score").alias("score"))


@R.query("random_search")
def random_search(t):
    """Boosting's parameters drawn with a seed, judged on the year after the fit."""
    rows, _ = _binned(t)
    rows = rows.select(F.col("o_orderkey").alias("key"), "h", "x", "y", "d")
    fit_rows, valid = rows.where(F.col("d") < F.lit("1997-01-01").cast("date")).cache(), rows.where((F.col("d") >= F.lit("1997-01-01").cast("date")) & _train()).cache()

    def fit(train, valid, seed, depth, ratio):
        return trees.scored(valid, [trees.forest(train, 3, ratio, depth, 5, 2, seed, bins=16)]).select("key", "y", "score")

    got = refit.search(fit_rows, valid, {"depth": [2, 3], "ratio": [1.0, 2.0, 4.0]}, 3, 7, [1, 2], fit, lambda s: metrics.auc(s, "score", "y").first()["auc"])
    return t.spark.createDataFrame([(i + 1, r["depth"], r["ratio"], round(r["metric"], 6)) for i, r in enumerate(got)], "rank long, depth long, ratio double, auc double")


QUERIES, ORACLE_SQL = R.queries, R.sql
