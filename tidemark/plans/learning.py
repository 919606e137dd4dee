"""Preparation, learners and regressions. Rows are orders with a late flag, or labelled documents."""

from pyspark.sql import functions as F


from tidemark.operators import metrics, models
from tidemark.plans.registry import Registry, n, r6

R = Registry()

_X = ["total", "age", "lines"]
_O = """SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, (o_orderstatus = 'F')::INT AS y, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 END AS total,
    (o_orderdate::DATE - DATE '1995-01-01')::DOUBLE / 365 AS age, CASE WHEN o_orderkey % 5 <> 0 THEN length(o_orderpriority)::DOUBLE END AS lines FROM orders"""


def _orders(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.when(k % 7 != 0, F.col("o_totalprice") / 1000).alias("total"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double") / 365).alias("age"), F.when(k % 5 != 0, F.length("o_orderpriority").cast("double")).alias("lines"),
    )


_TRAIN = "d < DATE '1999-01-01'"


def _train():
    return F.col("d") < F.lit("1999-01-01").cast("date")


@R.query("impute_median_flag", f"WITH o AS ({_O}), m AS (SELECT median(total) AS a, median(lines) AS b FROM o WHERE {_TRAIN}) SELECT o_orderkey, round(coalesce(total, a), 6) AS total, round(coalesce(lines, b), 6) AS lines, (total IS NULL)::INT::DOUBLE AS total_missing FROM o, m")
def impute_median_flag(t):
    return models.impute_median(_orders(t), ["total", "lines"], _train(), 1).select("o_orderkey", r6("total").alias("total"), r6("lines").alias("lines"), "total_missing")


@R.query("standardise", f"WITH o AS ({_O}), m AS (SELECT avg(total) AS a, stddev_pop(total) AS s, avg(age) AS b, stddev_pop(age) AS z FROM o WHERE {_TRAIN}) SELECT o_orderkey, round((total - a) / s, 6) AS total, round((age - b) / z, 6) AS age FROM o, m")
def standardise(t):
    return models.standardise(_orders(t), ["total", "age"], _train()).select("o_orderkey", r6("total").alias("total"), r6("age").alias("age"))


def _ready(t):
    df = models.impute_median(_orders(t), _X, _train(), 3)
    return df, df.where(_train())


def _auc(df):
    return metrics.auc(df.where(~_train()), "score", "y").select(n("n").alias("n"), r6("auc").alias("auc"))


@R.query("ml_logistic")
def ml_logistic(t):
    df, train = _ready(t)
    return _auc(models.logistic(models.balanced_weight(train, "y"), df, _X, "y", "weight"))


@R.query("ml_gbt")
def ml_gbt(t):
    df, train = _ready(t)
    return _auc(models.boosted(train, df, _X, "y", trees=5))


@R.query("ml_balanced_forest")
def ml_balanced_forest(t):
    df, train = _ready(t)
    return _auc(models.forest_score(models.balanced_forest(train, _X, "y", "o_orderkey", bags=2), df, _X))


@R.query("feature_importance")
def feature_importance(t):
    _, train = _ready(t)
    ranked = models.importances(models.balanced_forest(train, _X, "y", "o_orderkey", bags=2), _X)
    return t.spark.createDataFrame([(f, i + 1) for i, (f, _) in enumerate(ranked)], "feature string, rank long")


@R.query("tree_attribution")
def tree_attribution(t):
    df, train = _ready(t)
    a = models.tree_attribution(models.balanced_forest(train, _X, "y", "o_orderkey", bags=1, trees=3), df.where(~_train()).select("o_orderkey", *_X), _X)
    return a.select("o_orderkey", *[r6(f"attr_{x}").alias(f"attr_{x}") for x in _X])


@R.query("group_kfold")
def group_kfold(t):
    df, _ = _ready(t)
    return metrics.auc(models.out_of_fold(df, _X, "y", "o_custkey", 3), "score", "y").select(n("n").alias("n"), r6("auc").alias("auc"))


@R.query("isotonic_calibration")
def isotonic_calibration(t):
    df, train = _ready(t)
    c = models.isotonic(train, df.where(~_train()), "total", "y")
    return c.groupBy("y").agg(n(F.count("*")).alias("n"), r6(F.avg("calibrated")).alias("mean"))


@R.query("sample_weights", f"""WITH o AS ({_O}) SELECT o_orderkey, round(1.0 / count(*) OVER (PARTITION BY o_custkey, d), 6) AS dedup, round(exp(-(DATE '2001-12-31' - d) / 365), 6) AS near, round(0.5 + 0.5 * (d - DATE '1995-01-01') / (DATE '2001-12-31' - DATE '1995-01-01'), 6) AS ramp FROM o""")
def sample_weights(t):
    from pyspark.sql import Window

    end, start = F.lit("2001-12-31").cast("date"), F.lit("1995-01-01").cast("date")
    o = _orders(t)
    same = F.count("*").over(Window.partitionBy("o_custkey", "d"))
    return o.select("o_orderkey", r6(1 / same).alias("dedup"), r6(F.exp(-F.datediff(end, "d") / 365)).alias("near"), r6(0.5 + 0.5 * F.datediff("d", start) / F.datediff(end, start)).alias("ramp"))


@R.query("ols_residual", f"""WITH o AS (SELECT *, age * age AS age2 FROM ({_O})), f AS (SELECT avg(total) AS my, avg(age) AS m1, avg(age2) AS m2, covar_pop(total, age) AS y1, covar_pop(total, age2) AS y2, var_pop(age) AS v1, var_pop(age2) AS v2, covar_pop(age, age2) AS c FROM o WHERE total IS NOT NULL AND {_TRAIN}),
    b AS (SELECT *, (y1 * v2 - y2 * c) / (v1 * v2 - c * c) AS b1, (y2 * v1 - y1 * c) / (v1 * v2 - c * c) AS b2 FROM f) SELECT o_orderkey, round(total - (my + b1 * (age - m1) + b2 * (age2 - m2)), 2) + 0 AS res FROM o, b WHERE total IS NOT NULL""")
def ols_residual(t):
    """What a parabola fitted on the training rows leaves."""
    o = _orders(t).withColumn("age2", F.col("age") * F.col("age"))
    names, beta, _ = models.ols(o.where(_train()), "total", ["age", "age2"])
    fit = F.lit(float(beta[0])) + F.col("age") * float(beta[1]) + F.col("age2") * float(beta[2])
    return o.where("total is not null").select("o_orderkey", (F.round(F.col("total") - fit, 2) + F.lit(0.0)).alias("res"))


_M = "SELECT date_trunc('month', o_orderdate)::DATE AS m, avg(o_totalprice) / 1000 AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1"


@R.query("ols_newey_west", f"""WITH m AS ({_M}), b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM m),
    u AS (SELECT m.*, y - b0 - b1 * x AS u FROM m, b), g AS (SELECT *, u AS g0, x * u AS g1, lag(u) OVER w AS a0, lag(x * u) OVER w AS a1, lag(u, 2) OVER w AS c0, lag(x * u, 2) OVER w AS c1, lag(u, 3) OVER w AS e0, lag(x * u, 3) OVER w AS e1 FROM u WINDOW w AS (ORDER BY m)),
    s AS (SELECT sum(g0 * g0) + 1.5 * sum(g0 * a0) + 1.0 * sum(g0 * c0) + 0.5 * sum(g0 * e0) AS s00, sum(g1 * g1) + 1.5 * sum(g1 * a1) + 1.0 * sum(g1 * c1) + 0.5 * sum(g1 * e1) AS s11,
      sum(g0 * g1) + 0.75 * (sum(g0 * a1) + sum(g1 * a0)) + 0.5 * (sum(g0 * c1) + sum(g1 * c0)) + 0.25 * (sum(g0 * e1) + sum(g1 * e0)) AS s01 FROM g)
    SELECT round(b1, 6) AS slope, round(sqrt((sx * sx * s00 - 2 * n * sx * s01 + n * n * s11)) / (n * sxx - sx * sx), 6) AS se FROM b, s""")
def ols_newey_west(t):
    m = t.orders.groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg((F.avg("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))
    _, beta, se = models.ols(m, "y", ["x"], ["m"], 3)
    # Read from the data, bounded: one row.
    return m.agg(F.lit(round(float(beta[1]), 6)).alias("slope"), F.lit(round(float(se[1]), 6)).alias("se"))


@R.query("trend_slope", "SELECT o_custkey, round(regr_slope(o_totalprice, i), 4) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) GROUP BY 1")
def trend_slope(t):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.withColumn("i", i.cast("double")).groupBy("o_custkey").agg(F.round(F.regr_slope("o_totalprice", "i"), 4).alias("slope"))


@R.query("udf_scalar")
def udf_scalar(t):
    """A pandas function as a column."""
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("long")
    def vowels(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.str.count("[aeiouAEIOU]").fillna(0).astype("int64")

    return t.part.select("p_partkey", vowels("p_name").alias("vowels"))


R.sql["udf_scalar"] = "SELECT p_partkey, len(regexp_replace(p_name, '[^aeiouAEIOU]', '', 'g'))::BIGINT AS vowels FROM part"


@R.query("udaf_grouped", "SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 4) AS gmean FROM orders GROUP BY 1")
def udaf_grouped(t):
    """A grouped aggregate in pandas: partial sums per task first, so no group is gathered."""
    import pandas as pd

    def parts(batches):
        import numpy as np

        for pdf in batches:
            yield pdf.assign(s=np.log(pdf["o_totalprice"]), c=1).groupby("o_custkey", as_index=False)[["s", "c"]].sum()

    @F.pandas_udf("double")
    def mean(s: pd.Series, c: pd.Series) -> pd.Series:
        import numpy as np

        return np.exp(s / c)

    p = t.orders.select("o_custkey", "o_totalprice").mapInPandas(parts, "o_custkey long, s double, c long")
    p = p.groupBy("o_custkey").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    # The sums of many customers are one batch: no call and no frame for each of them.
    return p.select("o_custkey", F.round(mean("s", "c"), 4).alias("gmean"))


@R.query("udtf_rows", r"SELECT p_partkey, unnest(regexp_extract_all(p_type, '[A-Z]+')) AS word FROM part")
def udtf_rows(t):
    """A table function over each row, called laterally."""

    @F.udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            import re

            for w in re.findall("[A-Z]+", text or ""):
                yield (w,)

    t.spark.udtf.register("tidemark_words", Words)
    t.part.select("p_partkey", "p_type").createOrReplaceTempView("tidemark_parts")
    return t.spark.sql("SELECT p_partkey, word FROM tidemark_parts, LATERAL tidemark_words(p_type)")


QUERIES, ORACLE_SQL = R.queries, R.sql
