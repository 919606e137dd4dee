"""Joins: equality, as-of, range, self and graph joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import network
from tidemark.operators import temporal as T
from tidemark.operators.metrics import percentiles
from tidemark.plans.registry import Registry, day, n, r6, text_of

R = Registry()

_O = "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, o_totalprice, o_orderpriority, o_orderstatus FROM orders"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", day("o_orderdate").alias("d"), "o_totalprice", "o_orderpriority", "o_orderstatus")


@R.query("left_join", "SELECT c_custkey, round(v, 6) AS v FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join(t):
    block = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    return t.customer.select("c_custkey").join(block, "c_custkey", "left").select("c_custkey", r6("v").alias("v"))


@R.query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def inner_join(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@R.query(
    "multiway_join",
    """SELECT n_name, r_name, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
)
def multiway_join(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    j = per.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name", "r_name").agg(n(F.sum("k")).alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@R.query("inner_join_multi", "SELECT a.user_id, a.event_type, count(*)::BIGINT AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts::DATE = b.ts::DATE AND a.event_id < b.event_id GROUP BY 1, 2")
def inner_join_multi(t):
    # Pairs within a key are counted from the key's size, not made.
    k = t.events.groupBy("user_id", "event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("k")).where("k > 1")
    return k.groupBy("user_id", "event_type").agg(n(F.sum(F.col("k") * (F.col("k") - 1) / 2)).alias("pairs"))


@R.query("dedup_left_join", "SELECT c_custkey, o.o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def dedup_left_join(t):
    one = T.latest_per_key(t.orders, ["o_custkey"], [F.asc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return t.customer.select("c_custkey").join(one, "c_custkey", "left")


@R.query(
    "timeseries_join",
    """SELECT strftime(m, '%Y-%m-%d') AS month, round(a, 2) AS f, round(b, 2) AS o FROM (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (m)""",
)
def timeseries_join(t):
    of = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias(name))
    return of("F", "f").join(of("O", "o"), "m", "left").select(text_of("m").alias("month"), "f", "o")


@R.query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@R.query("anti_join", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_join(t):
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


_LABEL = f"""WITH o AS ({_O}) SELECT o_orderkey, EXISTS (SELECT 1 FROM o e WHERE e.o_custkey = o.o_custkey AND e.o_orderpriority = '1-URGENT'
    AND e.d - o.d BETWEEN 0 AND {{days}} {{more}})::BIGINT AS label FROM o"""


def _label(t, days, cutoff=None):
    ev = _orders(t).where("o_orderpriority = '1-URGENT'").select("o_custkey", "d")
    return T.label_within(_orders(t).select("o_orderkey", "o_custkey", "d"), ev, "o_custkey", "d", "d", days, cutoff).select("o_orderkey", "label")


@R.query("label_window_exists", _LABEL.format(days=1095, more=""))
def label_window_exists(t):
    return _label(t, 1095)


@R.query("label_asof", _LABEL.format(days=1095, more="AND e.d < DATE '1999-01-01'"))
def label_asof(t):
    return _label(t, 1095, "1999-01-01")


@R.query(
    "past_window_counts",
    f"""WITH o AS ({_O}) SELECT a.o_orderkey, count(CASE WHEN a.d - b.d <= 365 THEN 1 END)::BIGINT AS n1, count(CASE WHEN a.d - b.d <= 1095 THEN 1 END)::BIGINT AS n3,
    least(coalesce(a.d - max(b.d), 3650), 3650)::BIGINT AS days_since FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.d < a.d GROUP BY a.o_orderkey, a.d""",
)
def past_window_counts(t):
    """Strictly earlier orders of the customer within one and three years, and days since the last one."""
    panel = _orders(t).select("o_orderkey", "o_custkey", "d")
    out = T.past_counts(panel, panel, "o_custkey", "d", "d", {"n1": (1, 365), "n3": (1, 1095)})
    return T.days_since_last(out, panel, "o_custkey", "d", "d", 3650).select("o_orderkey", "n1", "n3", "days_since")


@R.query(
    "past_window_by_type",
    f"""WITH o AS ({_O}) SELECT a.o_orderkey, count(CASE WHEN b.o_orderstatus = 'F' THEN 1 END)::BIGINT AS f, count(CASE WHEN b.o_orderpriority LIKE '1%' THEN 1 END)::BIGINT AS urgent
    FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.d < a.d AND a.d - b.d <= 730 GROUP BY 1""",
)
def past_window_by_type(t):
    o = _orders(t)
    conds = {"f": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority").startswith("1")}
    return T.past_counts(o.select("o_orderkey", "o_custkey", "d"), o, "o_custkey", "d", "d", {"f": (1, 730), "urgent": (1, 730)}, conds).select("o_orderkey", "f", "urgent")


@R.query(
    "past_window_trades",
    f"""WITH o AS ({_O}) SELECT a.o_orderkey, count(b.o_orderkey)::BIGINT AS year, count(CASE WHEN a.d - b.d <= 91 THEN 1 END)::BIGINT AS quarter
    FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.d - b.d BETWEEN 1 AND 366 GROUP BY 1""",
)
def past_window_trades(t):
    o = _orders(t).select("o_orderkey", "o_custkey", "d")
    return T.past_counts(o, o, "o_custkey", "d", "d", {"year": (1, 366), "quarter": (1, 91)}).select("o_orderkey", "year", "quarter")


_LI = "SELECT l_suppkey AS k, l_shipdate::DATE AS ld, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"


def _ships(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("k"), day("l_shipdate").alias("ld")).agg(F.max("l_extendedprice").alias("v"))


def _asked(t):
    s = F.broadcast(t.supplier.agg(F.count("*").alias("s")))
    return _orders(t).crossJoin(s).select("o_orderkey", (F.col("o_custkey") % F.col("s")).alias("k"), "d")


_ASK = f"SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) AS k, d FROM ({_O})"


@R.query("asof_join_backward", f"WITH a AS ({_ASK}), l AS ({_LI}) SELECT o_orderkey, strftime(ld, '%Y-%m-%d') AS day, v FROM a ASOF LEFT JOIN l ON a.k = l.k AND a.d > l.ld")
def asof_join_backward(t):
    return T.asof_backward(_asked(t), _ships(t), "k", "d", "ld", ["v"]).select("o_orderkey", text_of("_day").alias("day"), "v")


@R.query("asof_join_tolerance", f"WITH a AS ({_ASK}), l AS ({_LI}) SELECT o_orderkey, CASE WHEN d - ld <= 3 THEN v END AS v FROM a ASOF LEFT JOIN l ON a.k = l.k AND a.d >= l.ld")
def asof_join_tolerance(t):
    return T.asof_backward(_asked(t), _ships(t), "k", "d", "ld", ["v"], strict=False, tolerance=3).select("o_orderkey", "v")


@R.query("asof_join_forward", f"WITH a AS ({_ASK}), l AS ({_LI}) SELECT o_orderkey, CASE WHEN ld - d <= 240 THEN v END AS v, CASE WHEN ld - d <= 240 THEN strftime(ld, '%Y-%m-%d') END AS day FROM a ASOF LEFT JOIN l ON a.k = l.k AND a.d <= l.ld")
def asof_join_forward(t):
    return T.asof_forward(_asked(t), _ships(t), "k", "d", "ld", ["v"], 240).select("o_orderkey", "v", text_of("_day").alias("day"))


@R.query(
    "forward_return",
    f"""WITH a AS ({_ASK}), l AS ({_LI}), e AS (SELECT o_orderkey, a.k, ld AS d0, v AS p0 FROM a ASOF LEFT JOIN l ON a.k = l.k AND (a.d + 1) <= l.ld),
    x AS (SELECT e.*, ld AS d1, v AS p1 FROM e ASOF LEFT JOIN l ON e.k = l.k AND (e.d0 + 182) >= l.ld)
    SELECT o_orderkey, round(p1 / nullif(p0, 0) - 1, 6) AS ret, (d1 < d0 + 175)::BIGINT AS dark FROM x WHERE d0 IS NOT NULL""",
)
def forward_return(t):
    """First price from t + 1 on, last price up to 182 days after it, and whether prices stop a week before."""
    ships = _ships(t)
    a = _asked(t).withColumn("t1", F.date_add("d", 1))
    e = T.asof_forward(a, ships, "k", "t1", "ld", ["v"], 100_000).where("_day is not null").select("o_orderkey", "k", F.col("_day").alias("d0"), F.col("v").alias("p0"))
    e = e.withColumn("t2", F.date_add("d0", 182))
    x = T.asof_backward(e, ships, "k", "t2", "ld", ["v"], strict=False)
    return x.select("o_orderkey", r6(F.try_divide("v", "p0") - 1).alias("ret"), n(F.col("_day") < F.date_add("d0", 175)).alias("dark"))


@R.query(
    "reindex_ffill",
    """WITH days AS (SELECT DISTINCT ts::DATE AS d FROM events), p AS (SELECT user_id, ts::DATE AS d, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT u.user_id, strftime(d, '%Y-%m-%d') AS day, last_value(v IGNORE NULLS) OVER (PARTITION BY u.user_id ORDER BY d) AS v FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN days LEFT JOIN p USING (user_id, d)""",
)
def reindex_ffill(t):
    """Each buyer's largest purchase of a day on the calendar of all days, carried forward. The calendar is one row with as many days as there are."""
    e = t.events.withColumn("d", day("ts"))
    p = e.where("event_type = 'purchase'").groupBy("user_id", "d").agg(F.max("value").alias("v"))
    calendar = F.broadcast(e.select("d").distinct().agg(F.collect_list("d").alias("days")))
    on = p.select("user_id").distinct().crossJoin(calendar).select("user_id", F.explode("days").alias("d")).join(p, ["user_id", "d"], "left")
    upto = Window.partitionBy("user_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return on.select("user_id", text_of("d").alias("day"), F.last("v", ignorenulls=True).over(upto).alias("v"))


@R.query(
    "lag_gap_pair",
    f"""WITH o AS ({_O}), p AS (SELECT *, lag(d) OVER w AS pd, lag(o_totalprice) OVER w AS pp FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey))
    SELECT o_orderkey, CASE WHEN d - pd BETWEEN 30 AND 300 THEN round(o_totalprice - pp, 6) END AS diff FROM p""",
)
def lag_gap_pair(t):
    p = T.previous(_orders(t), "o_custkey", ["d", "o_orderkey"], ["o_totalprice"], "d", (30, 300))
    return p.select("o_orderkey", r6(F.col("o_totalprice") - F.col("prev_o_totalprice")).alias("diff"))


@R.query(
    "next_and_after_next",
    f"""WITH o AS ({_O}) SELECT a.o_orderkey, min(CASE WHEN b.d - a.d BETWEEN 270 AND 460 THEN b.d - a.d END)::BIGINT AS nxt,
    min(CASE WHEN b.d - a.d BETWEEN 630 AND 820 THEN b.d - a.d END)::BIGINT AS after FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.d > a.d GROUP BY 1""",
)
def next_and_after_next(t):
    o = _orders(t).select("o_orderkey", "o_custkey", "d")
    days = o.select("o_custkey", F.col("d").alias("ed")).distinct()
    for name, low, high in (("nxt", 270, 460), ("after", 630, 820)):
        o = o.withColumn("_t", F.date_add("d", low))
        o = T.asof_forward(o, days, "o_custkey", "_t", "ed", [], high - low).withColumn(name, n(F.datediff("_day", "d"))).drop("_t", "_day")
    return o.select("o_orderkey", "nxt", "after")


# A filing is a customer's year; its comparative column is the figure that the next year repeats, here off by the number of late orders.
_F = "SELECT o_custkey AS k, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS cur, round(sum(o_totalprice) + 100 * count(*) FILTER (o_orderstatus = 'P'), 2) AS again FROM orders GROUP BY 1, 2"


def _filings(t):
    late = F.sum(F.when(F.col("o_orderstatus") == "P", 100.0).otherwise(0.0))
    g = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return g.agg(F.round(F.sum("o_totalprice"), 2).alias("cur"), F.round(F.sum("o_totalprice") + late, 2).alias("again"))


@R.query("comparative_mismatch", f"WITH f AS ({_F}) SELECT a.k, a.y::BIGINT AS y, (abs(a.again - a.cur) > 0.0005 * abs(a.cur) AND abs(a.again - a.cur) > 50)::BIGINT AS differs FROM f a JOIN f b ON b.k = a.k AND b.y = a.y + 1")
def comparative_mismatch(t):
    f = _filings(t)
    nxt = f.select("k", (F.col("y") - 1).alias("y"))
    return f.join(nxt, ["k", "y"]).select("k", n("y").alias("y"), n(S.rel_diff(F.col("again"), F.col("cur"), 0.0005, 50.0)).alias("differs"))


@R.query("revised_last_year", f"WITH f AS ({_F}) SELECT a.k, a.y::BIGINT AS y, round(a.cur - b.cur, 2) AS change, (b.again <> b.cur)::BIGINT AS revised FROM f a LEFT JOIN f b ON b.k = a.k AND b.y = a.y - 1")
def revised_last_year(t):
    f = _filings(t)
    before = f.select("k", (F.col("y") + 1).alias("y"), F.col("cur").alias("was"), F.col("again").alias("was2"))
    return f.join(before, ["k", "y"], "left").select("k", n("y").alias("y"), F.round(F.col("cur") - F.col("was"), 2).alias("change"), n(F.col("was2") != F.col("was")).alias("revised"))


@R.query(
    "fallback_join",
    """WITH k AS (SELECT doc_id, quality FROM labels), s AS (SELECT source, max(doc_id) AS any_id FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT d.doc_id, coalesce(k.quality, f.quality)::BIGINT AS quality, (k.doc_id IS NULL)::BIGINT AS by_source FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (source) LEFT JOIN k f ON f.doc_id = s.any_id""",
)
def fallback_join(t):
    """By the id, else by the source's latest labelled document; the fallback is looked up for the rest only."""
    labels, docs = t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "source")
    own = docs.join(labels, "doc_id").select("doc_id", n("quality").alias("quality"), F.lit(0).cast("long").alias("by_source"))
    by = docs.join(labels, "doc_id").groupBy("source").agg(F.max_by("quality", "doc_id").alias("quality"))
    rest = docs.join(labels, "doc_id", "left_anti").join(by, "source", "left")
    return own.unionByName(rest.select("doc_id", n("quality").alias("quality"), F.lit(1).cast("long").alias("by_source")))


@R.query(
    "link_resolution",
    f"""WITH o AS ({_O}), c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT c_custkey, o_orderkey AS link FROM c JOIN o ON o_custkey = c_custkey
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY (d >= DATE '1997-01-01' AND d < DATE '1998-01-01') DESC, d, o_orderkey) = 1""",
)
def link_resolution(t):
    """Candidates valid around a date first, then the rest; the first of them is the link."""
    valid = ~((F.col("d") >= F.lit("1997-01-01").cast("date")) & (F.col("d") < F.lit("1998-01-01").cast("date")))
    best = _orders(t).groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(valid, "d", "o_orderkey")).alias("link"))
    return t.customer.select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "link")


@R.query(
    "name_match_unique",
    r"""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS stem, array_to_string(list_slice(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 2), ' ') AS two FROM part),
    u AS (SELECT two, min(p_partkey) AS k FROM p GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), s AS (SELECT stem, min(p_partkey) AS k FROM p GROUP BY 1)
    SELECT p.p_partkey, coalesce(s.k, u.k) AS matched, (u.k IS NOT NULL)::BIGINT AS two_words FROM p LEFT JOIN s USING (stem) LEFT JOIN u USING (two)""",
)
def name_match_unique(t):
    stem = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "))
    p = t.part.select("p_partkey", stem.alias("stem"), F.array_join(F.slice(F.split(stem, " "), 1, 2), " ").alias("two"))
    u = p.groupBy("two").agg(F.min("p_partkey").alias("u"), F.countDistinct("p_partkey").alias("c")).where("c = 1").drop("c")
    s = p.groupBy("stem").agg(F.min("p_partkey").alias("s"))
    return p.join(s, "stem", "left").join(u, "two", "left").select("p_partkey", F.coalesce("s", "u").alias("matched"), n(F.col("u").isNotNull()).alias("two_words"))


@R.query(
    "two_hop_links",
    """WITH e AS (SELECT DISTINCT l_suppkey AS firm, l_partkey AS person FROM lineitem), s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    SELECT a.firm, count(DISTINCT b.firm)::BIGINT AS linked, count(DISTINCT CASE WHEN s.s_suppkey IS NOT NULL THEN b.firm END)::BIGINT AS flagged
    FROM e a JOIN e b ON a.person = b.person AND a.firm <> b.firm LEFT JOIN s ON s.s_suppkey = b.firm GROUP BY 1""",
)
def two_hop_links(t):
    """Firms reached through a shared person; persons of more than 1,000 firms are taken as sets."""
    e = t.lineitem.select(F.col("l_suppkey").alias("firm"), F.col("l_partkey").alias("person"))
    bad = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("firm"))
    return network.linked(e, bad).select("firm", n("linked").alias("linked"), n("flagged").alias("flagged"))


@R.query(
    "fiscal_year_join",
    """WITH f AS (SELECT o_custkey AS k, year(o_orderdate) - CASE WHEN month(o_orderdate) <= 5 THEN 1 ELSE 0 END AS fy, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
    SELECT a.k, a.fy::BIGINT AS fy, a.v, b.v AS prior FROM f a JOIN f b ON b.k = a.k AND b.fy = a.fy - 1""",
)
def fiscal_year_join(t):
    f = t.orders.groupBy(F.col("o_custkey").alias("k"), S.fiscal_year(F.col("o_orderdate")).alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return f.join(f.select("k", (F.col("fy") + 1).alias("fy"), F.col("v").alias("prior")), ["k", "fy"]).select("k", n("fy").alias("fy"), "v", "prior")


@R.query("broadcast_scalar", "SELECT o_orderkey, (o_totalprice > m)::BIGINT AS above FROM orders, (SELECT median(o_totalprice) AS m FROM orders)")
def broadcast_scalar(t):
    m = percentiles(t.orders, "o_totalprice", [0.5], names=["m"])
    return t.orders.crossJoin(F.broadcast(m)).select("o_orderkey", n(F.col("o_totalprice") > F.col("m")).alias("above"))


@R.query("cross_join", "SELECT r_name, mktsegment FROM region, (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer)")
def cross_join(t):
    return t.region.select("r_name").crossJoin(F.broadcast(t.customer.select(F.col("c_mktsegment").alias("mktsegment")).distinct()))


@R.query(
    "availability_date",
    """SELECT o_orderkey, strftime(coalesce(p, d + 31), '%Y-%m-%d') AS available FROM (SELECT o_orderkey, o_orderdate::DATE AS d,
    (SELECT min(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS p FROM orders)""",
)
def availability_date(t):
    """An event counts from the day it became public, or 31 days after it was written."""
    p = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(day("l_shipdate")).alias("p"))
    return t.orders.join(p, "o_orderkey", "left").select("o_orderkey", F.date_format(F.coalesce("p", F.date_add(day("o_orderdate"), 31)), "yyyy-MM-dd").alias("available"))


@R.query("late_data_drop", "SELECT count(*)::BIGINT AS kept, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) <= 46")
def late_data_drop(t):
    gap = F.datediff(day("l_shipdate"), day("o_orderdate"))
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where(gap <= 46).agg(n(F.count("*")).alias("kept"), F.round(F.sum("l_quantity"), 2).alias("qty"))


QUERIES, ORACLE_SQL = R.queries, R.sql
