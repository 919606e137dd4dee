"""Portfolio queries. An entity is a user of events, a period a day, a price the day's last value."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as P
from tidemark.operators.metrics import percentiles
from tidemark.plans.registry import Registry, n, r6, text_of

R = Registry()

_P = """WITH c AS (SELECT user_id AS k, ts::DATE AS p, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), r AS (SELECT *, close / lag(close) OVER (PARTITION BY k ORDER BY p) - 1 AS ret0 FROM c),
s AS (SELECT *, max(p) OVER (PARTITION BY k) AS last FROM r WHERE k NOT IN (SELECT k FROM r WHERE ret0 > 400 OR close > 460)),
a AS (SELECT k, p, close, CASE WHEN p = last AND (SELECT max(ts)::DATE FROM events) - last > 1 THEN (1 + ret0) * 0.7 - 1 ELSE ret0 END AS ret FROM s),
x AS (SELECT *, coalesce(CASE WHEN lead(p) OVER w = p + 1 THEN lead(ret) OVER w END, 0) AS nxt FROM a WINDOW w AS (PARTITION BY k ORDER BY p))"""


def _panel(t):
    e = t.events.withColumnRenamed("user_id", "k")
    return P.panel(e, "k", F.col("ts").cast("date"), "value", ["ts", "event_id"], 400, 0.0, 460, 1, 0.3)


@R.query("month_panel", f"{_P} SELECT k, strftime(p, '%Y-%m-%d') AS p, close, round(ret, 6) AS ret, round(nxt, 6) AS nxt FROM x")
def month_panel(t):
    return _panel(t).select("k", text_of("p").alias("p"), "close", r6("ret").alias("ret"), r6("nxt").alias("nxt"))


_L = f"""{_P}, q AS (SELECT *, greatest(1, ceil((row_number() OVER (PARTITION BY p ORDER BY close, k) - 1) * 5 / (count(*) OVER (PARTITION BY p) - 1))) AS q, count(*) OVER (PARTITION BY p) AS n FROM x),
l AS (SELECT p, count(*) AS n, avg(nxt) FILTER (q = 5) AS high, avg(nxt) FILTER (q = 1) AS low, avg(nxt) FILTER (q < 5) AS rest FROM q WHERE n >= 10 GROUP BY 1)"""


@R.query("decile_portfolio", f"{_L} SELECT strftime(p, '%Y-%m-%d') AS p, n::BIGINT AS n, round(high, 6) AS high, round(low, 6) AS low, round(high - low, 6) AS spread, round(rest, 6) AS rest FROM l")
def decile_portfolio(t):
    g = P.legs(_panel(t), "k", "close", 5, 10)
    return g.select(text_of("p").alias("p"), n("n").alias("n"), *[r6(c).alias(c) for c in ("high", "low", "spread", "rest")])


@R.query("net_returns", f"{_L} SELECT strftime(p, '%Y-%m-%d') AS p, round(low - high - 0.0025 * 2 - 0.1 / 252, 6) AS net FROM l")
def net_returns(t):
    g = P.legs(_panel(t), "k", "close", 5, 10).withColumns({"gross": F.col("low") - F.col("high"), "turn": F.lit(2.0)})
    return g.select(text_of("p").alias("p"), r6(P.net(g, "gross", "turn", 0.0025, 0.1, 252)).alias("net"))


@R.query("signal_sets", """WITH g AS (SELECT user_id AS k, date_trunc('week', ts)::DATE AS w, count(DISTINCT CASE WHEN event_type = 'purchase' THEN ts::DATE END) AS buys, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS v, bool_and(event_type <> 'error') AS clean FROM events GROUP BY 1, 2)
    SELECT k, strftime(w, '%Y-%m-%d') AS week, CASE WHEN buys >= 2 AND clean THEN 'long' WHEN buys = 0 AND NOT clean THEN 'short' END AS side, round(v, 2) AS bought FROM g WHERE (buys >= 2 AND clean) OR (buys = 0 AND NOT clean)""")
def signal_sets(t):
    buy = F.col("event_type") == "purchase"
    g = t.events.groupBy(F.col("user_id").alias("k"), F.trunc("ts", "week").alias("w")).agg(F.countDistinct(F.when(buy, F.col("ts").cast("date"))).alias("buys"), F.sum(F.when(buy, F.col("value")).otherwise(0.0)).alias("v"), F.bool_and(F.col("event_type") != "error").alias("clean"))
    side = F.when((F.col("buys") >= 2) & F.col("clean"), "long").when((F.col("buys") == 0) & ~F.col("clean"), "short")
    return g.select("k", text_of("w").alias("week"), side.alias("side"), F.round("v", 2).alias("bought")).where("side is not null")


@R.query("holdings_clone", """WITH h AS (SELECT l_suppkey AS m, date_trunc('quarter', l_shipdate)::DATE AS q, l_partkey AS s, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT m, q, sum(v) AS v FROM h GROUP BY 1, 2),
    f AS (SELECT *, avg(v) OVER w AS score, count(*) OVER w AS c FROM t WINDOW w AS (PARTITION BY m ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), b AS (SELECT q, quantile_cont(score, 0.9) AS cut FROM f WHERE c >= 6 GROUP BY 1),
    top AS (SELECT f.m, f.q FROM f JOIN b USING (q) WHERE c >= 6 AND score >= cut) SELECT strftime(q, '%Y-%m-%d') AS quarter, m AS manager, s AS stock FROM h JOIN top USING (m, q) QUALIFY row_number() OVER (PARTITION BY m, q ORDER BY v DESC, s) <= 10""")
def holdings_clone(t):
    """The ten largest positions of each quarter's managers in the top tenth by their past eight quarters (six at least)."""
    h = t.lineitem.groupBy(F.col("l_suppkey").alias("m"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("q"), F.col("l_partkey").alias("s")).agg(F.sum("l_extendedprice").alias("v"))
    past = Window.partitionBy("m").orderBy("q").rowsBetween(-8, -1)
    f = h.groupBy("m", "q").agg(F.sum("v").alias("v")).select("m", "q", F.avg("v").over(past).alias("score"), F.count("*").over(past).alias("c")).where("c >= 6")
    cut = percentiles(f, "score", [0.9], ["q"], ["cut"])
    top = f.join(cut, "q").where("score >= cut").select("m", "q")
    w = Window.partitionBy("m", "q").orderBy(F.desc("v"), "s")
    return h.join(top, ["m", "q"]).withColumn("i", F.row_number().over(w)).where("i <= 10").select(text_of("q").alias("quarter"), F.col("m").alias("manager"), F.col("s").alias("stock"))


@R.query("select_then_test", """WITH m AS (SELECT o_orderpriority AS s, date_trunc('month', o_orderdate)::DATE AS m, avg(o_totalprice) / 250000 - 1 AS r FROM orders GROUP BY 1, 2),
    f AS (SELECT s, avg(r) FILTER (m < DATE '1998-01-01') / nullif(stddev_samp(r) FILTER (m < DATE '1998-01-01'), 0) * sqrt(12) AS chosen_by, avg(r) FILTER (m >= DATE '1998-01-01') * 12 AS mean, avg(r) FILTER (m >= DATE '1998-01-01') / nullif(stddev_samp(r) FILTER (m >= DATE '1998-01-01'), 0) * sqrt(12) AS sharpe FROM m GROUP BY 1)
    SELECT s AS signal, round(chosen_by, 6) AS chosen_by, round(mean, 6) AS mean, round(sharpe, 6) AS sharpe FROM f ORDER BY f.chosen_by DESC, s LIMIT 1""")
def select_then_test(t):
    """The signal that did best before a date, by what it did after."""
    m = t.orders.groupBy(F.col("o_orderpriority").alias("s"), F.trunc("o_orderdate", "MM").alias("m")).agg((F.avg("o_totalprice") / 250000 - 1).alias("r"))
    early = F.col("m") < F.lit("1998-01-01").cast("date")
    ratio = lambda c: F.try_divide(F.avg(F.when(c, F.col("r"))), F.stddev_samp(F.when(c, F.col("r")))) * F.sqrt(F.lit(12.0))
    f = m.groupBy("s").agg(ratio(early).alias("by"), (F.avg(F.when(~early, F.col("r"))) * 12).alias("mean"), ratio(~early).alias("sharpe"))
    return f.orderBy(F.desc("by"), "s").limit(1).select(F.col("s").alias("signal"), r6("by").alias("chosen_by"), r6("mean").alias("mean"), r6("sharpe").alias("sharpe"))


QUERIES, ORACLE_SQL = R.queries, R.sql
