"""Projections, filters, set operations, limits and scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.plans.registry import Registry, n, r6, text_of

R = Registry()


@R.query("filter_range_coerce", "SELECT p_partkey, p_type FROM part WHERE NOT coalesce(TRY_CAST(substr(p_brand, 7) AS INT) BETWEEN 20 AND 39, false)")
def filter_range_coerce(t):
    return t.part.where(~S.in_range_or_kept(F.substring("p_brand", 7, 9), 20, 39)).select("p_partkey", "p_type")


@R.query("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@R.query("filter_not_in", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y FROM orders WHERE year(o_orderdate) NOT IN (1996, 1999)")
def filter_not_in(t):
    y = F.year("o_orderdate")
    return t.orders.where(~y.isin(1996, 1999)).select("o_orderkey", n(y).alias("y"))


@R.query("filter_blank", "SELECT doc_id FROM documents WHERE coalesce(trim(split_part(text, chr(10), 2)), '') = ''")
def filter_blank(t):
    return t.documents.where(F.coalesce(F.trim(F.split_part("text", F.lit("\n"), F.lit(2))), F.lit("")) == "").select("doc_id")


@R.query("filter_conditional", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_returnflag FROM lineitem WHERE CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' ELSE l_linestatus = 'O' END")
def filter_conditional(t):
    ok = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F").otherwise(F.col("l_linestatus") == "O")
    return t.lineitem.where(ok).select("l_orderkey", n("l_linenumber").alias("line"), "l_returnflag")


@R.query("filter_prefix_regex", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_brand, 'Brand#1') OR regexp_matches(p_type, '(?i)steel|brass')")
def filter_prefix_regex(t):
    return t.part.where(F.col("p_brand").startswith("Brand#1") | F.col("p_type").rlike("(?i)steel|brass")).select("p_partkey", "p_type")


@R.query("coerce_cast", "SELECT doc_id, TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) AS v, TRY_CAST(substr(source, 4) AS BIGINT) AS s FROM documents")
def coerce_cast(t):
    return t.documents.select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).try_cast("double").alias("v"), F.substring("source", 4, 9).try_cast("long").alias("s"))


@R.query("filter_not_null", "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def filter_not_null(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where("quality is not null").select("doc_id", n("quality").alias("quality"))


@R.query("temporal_split", "SELECT CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'fit' WHEN o_orderdate < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS part, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def temporal_split(t):
    d = F.col("o_orderdate")
    part = F.when(d < F.lit("1998-01-01").cast("date"), "fit").when(d < F.lit("2000-01-01").cast("date"), "val").otherwise("test")
    return t.orders.groupBy(part.alias("part")).agg(n(F.count("*")).alias("n"), r6(F.avg("o_totalprice")).alias("mean"))


@R.query("drop_columns", "SELECT * EXCLUDE (o_orderdate, o_orderstatus) FROM orders")
def drop_columns(t):
    return t.orders.drop("o_orderdate", "o_orderstatus")


@R.query("filter_outlier", "SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE greatest(abs(l_quantity), abs(l_discount * 400), abs(l_tax * 400)) <= 30")
def filter_outlier(t):
    most = F.greatest(F.abs("l_quantity"), F.abs(F.col("l_discount") * 400), F.abs(F.col("l_tax") * 400))
    return t.lineitem.where(most <= 30).select("l_orderkey", n("l_linenumber").alias("line"))


@R.query(
    "universe_filter",
    """SELECT month, user_id, v FROM (SELECT *, count(*) OVER (PARTITION BY month) AS size FROM (
    SELECT strftime(ts, '%Y-%m-%d') AS month, user_id, round(max(value), 6) AS v FROM events WHERE value > 5 GROUP BY 1, 2)) WHERE size >= 100""",
)
def universe_filter(t):
    per = t.events.where("value > 5").groupBy(text_of("ts").alias("month"), "user_id").agg(r6(F.max("value")).alias("v"))
    return per.withColumn("size", F.count("*").over(Window.partitionBy("month"))).where("size >= 100").drop("size")


@R.query("entity_screen", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000 OR o_totalprice < 1000)")
def entity_screen(t):
    bad = t.orders.where("o_totalprice > 480000 or o_totalprice < 1000").select("o_custkey").distinct()
    return t.orders.join(bad, "o_custkey", "left_anti").select("o_custkey", "o_orderkey")


# Set operations.


@R.query("union_all", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t.customer.select(n("c_nationkey").alias("k")).unionByName(t.supplier.select(n("s_nationkey").alias("k")))


@R.query("union_distinct", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return union_all(t).distinct()


@R.query("intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect(t):
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O"))


@R.query("except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_(t):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@R.query("greatest_union", "SELECT doc_id, greatest(quality, toxic)::BIGINT AS y FROM labels")
def greatest_union(t):
    return t.labels.select("doc_id", n(F.greatest("quality", "toxic")).alias("y"))


@R.query("array_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1")
def array_distinct(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.array_distinct(F.collect_list("o_orderpriority"))), ",").alias("p"))


# Scalar functions.


@R.query("safe_ratio", "SELECT l_orderkey, l_linenumber::BIGINT AS line, round(CASE WHEN abs(l_tax) >= 1e-6 AND abs(l_quantity / l_tax) <= 500 THEN l_quantity / l_tax END, 6) AS v FROM lineitem")
def safe_ratio(t):
    return t.lineitem.select("l_orderkey", n("l_linenumber").alias("line"), r6(S.safe_ratio(F.col("l_quantity"), F.col("l_tax"), 500)).alias("v"))


@R.query("abs_ratio", "SELECT c_custkey, round(1000 / nullif(abs(c_acctbal), 0), 6) AS v FROM customer")
def abs_ratio(t):
    return t.customer.select("c_custkey", r6(S.abs_ratio(F.lit(1000.0), F.col("c_acctbal"))).alias("v"))


@R.query("signed_log", "SELECT c_custkey, round(sign(c_acctbal) * log10(1 + abs(c_acctbal)), 6) AS v, round(c_acctbal, 3) AS back FROM customer")
def signed_log(t):
    v = S.signed_log(F.col("c_acctbal"))
    return t.customer.select("c_custkey", r6(v).alias("v"), F.round(S.signed_exp(v), 3).alias("back"))


@R.query("rel_diff_flag", "SELECT l_orderkey, l_linenumber::BIGINT AS line, (abs(l_quantity - l_tax * 500) > 0.1 * abs(l_tax * 500) AND abs(l_quantity - l_tax * 500) > 3)::BIGINT AS f FROM lineitem")
def rel_diff_flag(t):
    return t.lineitem.select("l_orderkey", n("l_linenumber").alias("line"), n(S.rel_diff(F.col("l_quantity"), F.col("l_tax") * 500, 0.1, 3)).alias("f"))


@R.query("clip_log", "SELECT c_custkey, round(ln(1 + least(greatest(c_acctbal, 0), 500)), 6) AS v FROM customer")
def clip_log(t):
    return t.customer.select("c_custkey", r6(F.log1p(S.clip(F.col("c_acctbal"), 0.0, 500.0))).alias("v"))


@R.query("annualise", "SELECT user_id, round(stddev_pop(value) * sqrt(252), 6) AS vol, round(avg(value) * 12, 6) AS mean FROM events GROUP BY 1")
def annualise(t):
    return t.events.groupBy("user_id").agg(r6(F.stddev_pop("value") * F.sqrt(F.lit(252.0))).alias("vol"), r6(F.avg("value") * 12).alias("mean"))


@R.query("map_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 90 END::BIGINT AS days FROM orders")
def map_lookup(t):
    days = F.create_map(*[F.lit(x) for x in ("1-URGENT", 60, "2-HIGH", 75, "3-MEDIUM", 90)])
    return t.orders.select("o_orderkey", n(F.try_element_at(days, F.col("o_orderpriority"))).alias("days"))


@R.query("null_and", "SELECT d.doc_id, (l.quality * l.toxic)::BIGINT AS f FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_and(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", n(S.both(F.col("quality"), F.col("toxic"))).alias("f"))


@R.query("parse_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%Y-%m-%d') AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, NULL::VARCHAR AS e FROM orders")
def parse_dates(t):
    forms = {"a": "yyyyMMdd", "b": "yyyy-MM-dd", "c": "dd-MMM-yyyy", "d": "MMMM d yyyy"}
    written = {k: F.date_format("o_orderdate", f) for k, f in forms.items()} | {"e": F.lit("31.31.2000")}
    return t.orders.select("o_orderkey", *[F.date_format(S.parse_date(v), "yyyy-MM-dd").alias(k) for k, v in written.items()])


@R.query("date_diff", "SELECT l_orderkey, l_linenumber::BIGINT AS line, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS days, round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 365.25, 6) AS years FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def date_diff(t):
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", n("l_linenumber").alias("line"), n(gap).alias("days"), r6(gap / 365.25).alias("years"))


@R.query("year_shift_string", "SELECT o_orderkey, (year(o_orderdate) - 1)::VARCHAR || strftime(o_orderdate, '%m%d') AS before, (year(o_orderdate) + 1)::VARCHAR || strftime(o_orderdate, '%m%d') AS after FROM orders")
def year_shift_string(t):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.select("o_orderkey", S.year_shift(d, -1).alias("before"), S.year_shift(d, 1).alias("after"))


@R.query("doy_shift", "SELECT o_custkey, o_orderkey, d::BIGINT AS d, round(d - median(d) OVER (PARTITION BY o_custkey), 6) AS off FROM (SELECT *, dayofyear(o_orderdate) + CASE WHEN month(o_orderdate) <= 5 THEN 365 ELSE 0 END AS d FROM orders)")
def doy_shift(t):
    o = t.orders.withColumn("d", S.day_of_fiscal_year(F.col("o_orderdate")))
    mid = o.groupBy("o_custkey").agg(F.median("d").alias("mid"))
    return o.join(mid, "o_custkey").select("o_custkey", "o_orderkey", n("d").alias("d"), r6(F.col("d") - F.col("mid")).alias("off"))


@R.query("month_arith", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m-%d') AS m2, strftime(last_day(o_orderdate::DATE), '%Y-%m-%d') AS stop FROM orders")
def month_arith(t):
    return t.orders.select("o_orderkey", F.date_format(F.add_months(F.trunc("o_orderdate", "MM"), 2), "yyyy-MM-dd").alias("m2"), F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("stop"))


@R.query("fiscal_year", "SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) <= 5 THEN 1 ELSE 0 END)::BIGINT AS fy FROM orders")
def fiscal_year(t):
    return t.orders.select("o_orderkey", n(S.fiscal_year(F.col("o_orderdate"))).alias("fy"))


@R.query("deadline_filter", "SELECT l_orderkey, l_linenumber::BIGINT AS line, round(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_extendedprice * 1000 ELSE l_extendedprice END, 6) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) BETWEEN 0 AND 46")
def deadline_filter(t):
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    v = F.when(F.col("l_shipdate").cast("date") < F.lit("1998-01-01").cast("date"), F.col("l_extendedprice") * 1000).otherwise(F.col("l_extendedprice"))
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where(gap.between(0, 46)).select("l_orderkey", n("l_linenumber").alias("line"), r6(v).alias("v"))


QUERIES, ORACLE_SQL = R.queries, R.sql
