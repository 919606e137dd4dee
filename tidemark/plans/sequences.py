"""Window and sequence functions per entity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks as K
from tidemark.operators import sequence as Q
from tidemark.operators import temporal as T
from tidemark.operators.metrics import percentiles
from tidemark.plans.registry import Registry, day, n, r6, text_of

R = Registry()

#: A customer's year: the panel of most queries here.
_Y = "SELECT o_custkey AS k, year(o_orderdate)::BIGINT AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"


def _years(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k"), n(F.year("o_orderdate")).alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def _w():
    return Window.partitionBy("k").orderBy("y")


@R.query("lag_consecutive", f"SELECT k, y, CASE WHEN y - lag(y) OVER w = 1 THEN round(v - lag(v) OVER w, 2) END AS change FROM ({_Y}) WINDOW w AS (PARTITION BY k ORDER BY y)")
def lag_consecutive(t):
    return _years(t).select("k", "y", F.when(F.col("y") - F.lag("y").over(_w()) == 1, F.round(F.col("v") - F.lag("v").over(_w()), 2)).alias("change"))


@R.query("cumcount", f"SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS i FROM ({_Y})")
def cumcount(t):
    return _years(t).select("k", "y", n(F.row_number().over(_w()) - 1).alias("i"))


@R.query("rank_pct_avg", f"SELECT k, y, round((rank() OVER (PARTITION BY y ORDER BY floor(v / 1000)) + (count(*) OVER (PARTITION BY y, floor(v / 1000)) - 1) / 2) / count(*) OVER (PARTITION BY y), 6) AS pct FROM ({_Y})")
def rank_pct_avg(t):
    df = _years(t).withColumn("g", F.floor(F.col("v") / 1000))
    return K.with_rank_pct(df, ["y"], "g").select("k", "y", r6("pct").alias("pct"))


@R.query("rank_unit", f"SELECT k, y, round((row_number() OVER (PARTITION BY y ORDER BY v, k) - 1) / nullif(count(*) OVER (PARTITION BY y) - 1, 0), 6) AS u FROM ({_Y})")
def rank_unit(t):
    return K.with_rank_unit(_years(t), ["y"], "v", "k", "u").select("k", "y", r6("u").alias("u"))


@R.query("decile_qcut", f"SELECT k, y, greatest(1, ceil((row_number() OVER (PARTITION BY y ORDER BY v, k) - 1) * 10 / (count(*) OVER (PARTITION BY y) - 1)))::BIGINT AS d FROM ({_Y})")
def decile_qcut(t):
    return K.with_quantile(_years(t), ["y"], "v", "k", 10, "d").select("k", "y", n("d").alias("d"))


@R.query("trailing_stats", f"""SELECT k, y, CASE WHEN c >= 3 THEN round(m, 6) END AS mean, CASE WHEN c >= 3 THEN round(s, 6) END AS sd, CASE WHEN c >= 3 THEN round(g, 6) END AS slope FROM (SELECT k, y, count(v) OVER w AS c, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s,
    regr_slope(v, i) OVER w AS g FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) AS i FROM ({_Y})) WINDOW w AS (PARTITION BY k ORDER BY y ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""")
def trailing_stats(t):
    return Q.trailing(_years(t), ["k"], ["y"], "v", 4, 3).select("k", "y", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("slope").alias("slope"))


@R.query("expanding_count", "SELECT o_orderkey, count(*) OVER w AS orders, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) OVER w AS late FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_count(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", n(F.count("*").over(w)).alias("orders"), n(F.count(F.when(F.col("o_orderstatus") == "P", 1)).over(w)).alias("late"))


@R.query("max_drawdown", "SELECT user_id, round(min(value / nullif(m, 0) - 1), 6) AS worst FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) GROUP BY 1")
def max_drawdown(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.withColumn("m", F.max("value").over(w)).groupBy("user_id").agg(r6(F.min(F.try_divide("value", "m") - 1)).alias("worst"))


@R.query("period_return", "SELECT event_id, round(value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1, 6) AS ret FROM events")
def period_return(t):
    """There is no return on a price of zero."""
    was = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", r6(F.try_divide("value", was) - 1).alias("ret"))


@R.query("month_end_last", "SELECT o_custkey AS k, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1, 2")
def month_end_last(t):
    return Q.month_end(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey").select(F.col("o_custkey").alias("k"), text_of("month").alias("month"), "last")


@R.query("monthly_asof_signal", """WITH o AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), c AS (SELECT DISTINCT k, last_day(d) AS m FROM o)
    SELECT c.k, strftime(m, '%Y-%m-%d') AS month, CASE WHEN m - o.d < 365 THEN v END AS signal FROM (SELECT k, unnest(generate_series(date_trunc('month', min(m)), date_trunc('month', max(m)) + INTERVAL 12 MONTH, INTERVAL 1 MONTH))::DATE AS s, last_day(s) AS m FROM c GROUP BY k) c ASOF LEFT JOIN o ON o.k = c.k AND o.d <= c.m""")
def monthly_asof_signal(t):
    """At each month's end the latest value of the last 365 days."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k"), day("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"))
    span = o.groupBy("k").agg(F.trunc(F.min("d"), "MM").alias("a"), F.add_months(F.trunc(F.max("d"), "MM"), 12).alias("b"))
    months = span.select("k", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("s")).select("k", F.last_day("s").alias("m"))
    return T.asof_backward(months, o, "k", "m", "d", ["v"], strict=False, tolerance=364).select("k", text_of("m").alias("month"), F.col("v").alias("signal"))


@R.query("decayed_average", f"""SELECT k, y, round((v + coalesce(0.6 * lag(v) OVER w, 0) + coalesce(0.36 * lag(v, 2) OVER w, 0)) / (1 + CASE WHEN lag(v) OVER w IS NULL THEN 0 ELSE 0.6 END + CASE WHEN lag(v, 2) OVER w IS NULL THEN 0 ELSE 0.36 END), 1) AS s FROM ({_Y}) WINDOW w AS (PARTITION BY k ORDER BY y)""")
def decayed_average(t):
    return _years(t).select("k", "y", F.round(Q.decayed("v", ["k"], ["y"], [1.0, 0.6, 0.36]), 1).alias("s"))


@R.query("recursive_smooth", f"""WITH RECURSIVE p AS (SELECT k, y, v, row_number() OVER (PARTITION BY k ORDER BY y) AS i FROM ({_Y})), s AS (SELECT k, y, i, v AS s FROM p WHERE i = 1
    UNION ALL SELECT p.k, p.y, p.i, (p.v + 0.5 * s.s) / 1.5 FROM p JOIN s ON p.k = s.k AND p.i = s.i + 1) SELECT k, y, round(s, 4) AS s FROM s""")
def recursive_smooth(t):
    return Q.smoothed(_years(t), ["k"], "y", "v", 0.5).select("k", "y", F.round("smooth", 4).alias("s"))


@R.query("train_only_percentile", f"""WITH p AS (SELECT k, y, v, k % 25 AS g FROM ({_Y})), t AS (SELECT * FROM p WHERE y < 1999 OR k % 2 = 0), c AS (SELECT p.*, (SELECT count(*) FROM t WHERE t.g = p.g AND t.y = p.y) AS ng, (SELECT count(*) FROM t WHERE t.y = p.y) AS ny,
    (SELECT count(*) FROM t WHERE t.g = p.g AND t.y = p.y AND t.v < p.v) AS lg, (SELECT count(*) FROM t WHERE t.y = p.y AND t.v < p.v) AS ly FROM p)
    SELECT k, y, round(CASE WHEN ng > 0 THEN CASE WHEN ng >= 20 THEN lg / ng END WHEN ny >= 20 THEN ly / ny END, 6) AS pct FROM c""")
def train_only_percentile(t):
    p = _years(t).withColumns({"g": F.col("k") % 25, "train": (F.col("y") < 1999) | (F.col("k") % 2 == 0)})
    return Q.train_percentile(p, ["g", "y"], ["y"], "v", "train", 20).select("k", "y", r6("pct").alias("pct"))


@R.query("days_since_last", "SELECT event_id, least(coalesce(d - max(CASE WHEN event_type = 'error' THEN d END) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99), 99)::BIGINT AS since FROM (SELECT *, ts::DATE - DATE '2000-01-01' AS d FROM events)")
def days_since_last(t):
    e = t.events.select("event_id", "user_id", day("ts").alias("d"), "event_type")
    return T.days_since_last(e, e.where("event_type = 'error'"), "user_id", "d", "d", 99, "since").select("event_id", "since")


@R.query("changed_vs_prev", "SELECT o_orderkey, (o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w AND lag(o_orderkey) OVER w IS NOT NULL)::BIGINT AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def changed_vs_prev(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    was = F.lag("o_orderpriority").over(w)
    return t.orders.select("o_orderkey", n(~F.col("o_orderpriority").eqNullSafe(was) & F.lag("o_orderkey").over(w).isNotNull()).alias("changed"))


@R.query("turnover", """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m, o_custkey AS k FROM orders WHERE o_totalprice > 300000)
    SELECT strftime(a.m, '%Y-%m-%d') AS month, count(*)::BIGINT AS held, count(*) FILTER (b.k IS NULL)::BIGINT AS entered FROM m a LEFT JOIN m b ON b.k = a.k AND b.m = a.m - INTERVAL 1 MONTH GROUP BY 1""")
def turnover(t):
    m = t.orders.where("o_totalprice > 300000").select(F.trunc("o_orderdate", "MM").alias("m"), F.col("o_custkey").alias("k")).distinct()
    before = m.select(F.add_months("m", 1).alias("m"), "k", F.lit(1).alias("had"))
    return m.join(before, ["m", "k"], "left").groupBy("m").agg(n(F.count("*")).alias("held"), n(F.count(F.when(F.col("had").isNull(), 1))).alias("entered")).select(text_of("m").alias("month"), "held", "entered")


@R.query("above_group_median", f"SELECT k, y, (v > median(v) OVER (PARTITION BY y))::BIGINT AS above FROM ({_Y})")
def above_group_median(t):
    y = _years(t)
    return y.join(percentiles(y, "v", [0.5], ["y"], ["m"]), "y").select("k", "y", n(F.col("v") > F.col("m")).alias("above"))


@R.query("last_k_in_window", """SELECT k, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS last3, round(sum(o_totalprice), 2) AS total FROM (SELECT *, o_custkey AS k FROM orders WHERE o_orderdate < DATE '1999-01-01'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3) GROUP BY 1""")
def last_k_in_window(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = t.orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("date")).withColumn("i", F.row_number().over(w)).where("i <= 3")
    g = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("i", "o_orderkey"))).alias("s"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select("k", F.array_join(F.col("s.o_orderkey").cast("array<string>"), ",").alias("last3"), "total")


@R.query("label_maturity", """WITH g AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT DISTINCT lag::BIGINT AS lag, round(cume_dist() OVER (ORDER BY lag), 6) AS share FROM g""")
def label_maturity(t):
    """The share of eventual events that have happened within so many days; sums run over one row per day."""
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(n(F.datediff(day("l_shipdate"), day("o_orderdate"))).alias("lag")).agg(F.count("*").alias("c"))
    up = F.sum("c").over(Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    return j.select("lag", r6(up / F.sum("c").over(Window.partitionBy())).alias("share"))


QUERIES, ORACLE_SQL = R.queries, R.sql
