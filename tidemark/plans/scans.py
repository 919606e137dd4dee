"""Sources and sinks on the driver's tables."""

from pyspark.sql import functions as F

from tidemark.operators import temporal
from tidemark.plans.registry import Registry, n, r6, text_of
from tidemark.sources import readers, writers

R = Registry()


@R.query("scan_parquet", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_parquet(t):
    return t.customer.withColumn("c_nationkey", n("c_nationkey"))


@R.query("scan_multi", "SELECT 'customer' AS src, count(*)::BIGINT AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def scan_multi(t):
    parts = [x.select(F.lit(name).alias("src")).groupBy("src").agg(n(F.count("*")).alias("rows")) for name, x in (("customer", t.customer), ("orders", t.orders), ("lineitem", t.lineitem))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(t):
    o = temporal.latest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return o.select("o_custkey", "o_orderkey", text_of("o_orderdate").alias("day"))


@R.query("json_parse_props", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse_props(t):
    return t.events.select("event_id", F.from_json("props", "k long").k.alias("k"))


@R.query(
    "explode_json",
    """SELECT user_id, key, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM (
    SELECT user_id, unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY 1, 2""",
)
def explode_json(t):
    each = t.events.select("user_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "v"))
    return each.groupBy("user_id", "key").agg(n(F.count("*")).alias("n"), n(F.sum("v")).alias("total"))


@R.query("regex_row_parse", r"SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#(\d+)$', 1) AS word, CAST(regexp_extract(p_brand, '^([A-Za-z]+)#(\d+)$', 2) AS BIGINT) AS num FROM part WHERE regexp_matches(p_brand, '^[A-Za-z]+#\d+$')")
def regex_row_parse(t):
    p = r"^([A-Za-z]+)#(\d+)$"
    return t.part.where(F.col("p_brand").rlike(p)).select("p_partkey", F.regexp_extract("p_brand", p, 1).alias("word"), F.regexp_extract("p_brand", p, 2).cast("long").alias("num"))


@R.query("split_from_right", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS last, list_extract(string_split(url, '/'), -2) AS before FROM pages")
def split_from_right(t):
    parts = F.split("url", "/")
    return t.pages.select("page_id", F.try_element_at(parts, F.lit(-1)).alias("last"), F.try_element_at(parts, F.lit(-2)).alias("before"))


@R.query("scan_project", "SELECT l_orderkey, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY 1")
def scan_project(t):
    return t.lineitem.groupBy("l_orderkey").agg(r6(F.sum("l_quantity")).alias("qty"))


@R.query("filter_rlike_rows", r"SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]\d*$')")
def filter_rlike_rows(t):
    return t.part.where(F.col("p_brand").rlike(r"^Brand#[1-3]\d*$")).select("p_partkey", "p_brand")


@R.query("first_mapping", "SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_mapping(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("o_orderpriority"))


@R.query("documents_scan", "SELECT doc_id, length(text)::BIGINT AS chars, lang FROM documents")
def documents_scan(t):
    return t.documents.select("doc_id", n(F.length("text")).alias("chars"), "lang")


@R.query("anti_join_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_done(t):
    return readers.not_done(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.query(
    "argmax_choice",
    """SELECT o_custkey, o_orderkey AS chosen FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
    ORDER BY (o_orderpriority LIKE '1%') DESC, o_totalprice DESC, o_orderkey DESC) = 1""",
)
def argmax_choice(t):
    best = F.max_by("o_orderkey", F.struct(F.col("o_orderpriority").startswith("1"), "o_totalprice", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(best.alias("chosen"))


@R.query("topk_report", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_report(t):
    return writers.top_report(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@R.query("limit_n", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20")
def limit_n(t):
    return t.orders.select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(20)


@R.query("business_days", "SELECT strftime(d, '%Y-%m-%d') AS day, count(e.event_id)::BIGINT AS events FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS d FROM events) LEFT JOIN events e ON e.ts::DATE = d WHERE isodow(d) <= 5 GROUP BY 1")
def business_days(t):
    span = t.events.agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("d")).where(~F.dayofweek("d").isin(1, 7))
    per = t.events.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("k"))
    return days.join(per, "d", "left").select(text_of("d").alias("day"), n(F.coalesce("k", F.lit(0))).alias("events"))


@R.query("calendar_windows", "SELECT strftime(m, '%Y-%m-%d') AS start, strftime(last_day(m), '%Y-%m-%d') AS stop FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM orders)")
def calendar_windows(t):
    span = t.orders.agg(F.trunc(F.min("o_orderdate"), "MM").alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.select(text_of("m").alias("start"), F.date_format(F.last_day("m"), "yyyy-MM-dd").alias("stop"))


QUERIES, ORACLE_SQL = R.queries, R.sql
