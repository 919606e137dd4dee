"""Aggregations."""

from pyspark.sql import functions as F

from tidemark.operators import facts
from tidemark.operators.metrics import percentiles
from tidemark.plans.registry import Registry, day, n, r6, text_of

R = Registry()


@R.query("group_agg", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2")
def group_agg(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(n(F.count("*")).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), r6(F.avg("l_discount")).alias("disc"))


@R.query(
    "priority_pick",
    """SELECT k, concept, v FROM (SELECT l_orderkey AS k, l_linestatus AS concept, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey, l_linestatus
    ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_extendedprice) AS i FROM lineitem) WHERE i = 1""",
)
def priority_pick(t):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    f = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("concept"), rank.alias("rank"), "l_linenumber", F.col("l_extendedprice").alias("v"))
    return facts.priority_pick(f, ["k", "concept"], "rank", "l_linenumber", "v")


@R.query("first_per_group", "SELECT l_orderkey AS k, arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) AS v FROM lineitem GROUP BY 1")
def first_per_group(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.min_by("l_extendedprice", F.struct("l_linenumber", "l_extendedprice")).alias("v"))


@R.query("last_per_group", "SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1")
def last_per_group(t):
    return t.events.where("value is not null").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@R.query("pivot_wide", "SELECT l_orderkey AS k, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1")
def pivot_wide(t):
    w = facts.pivot_wide(t.lineitem.withColumnRenamed("l_orderkey", "k"), ["k"], "l_returnflag", "l_quantity", ["A", "N", "R"])
    return w.select("k", *[F.round(c, 2).alias(c) for c in ("A", "N", "R")])


@R.query("conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'purchase')::BIGINT AS buys, count(*) FILTER (event_type = 'click')::BIGINT AS clicks, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS spent FROM events GROUP BY 1")
def conditional_counts(t):
    of = lambda x: F.col("event_type") == x
    return t.events.groupBy("user_id").agg(n(F.count_if(of("purchase"))).alias("buys"), n(F.count_if(of("click"))).alias("clicks"), F.round(F.coalesce(F.sum(F.when(of("purchase"), F.col("value"))), F.lit(0.0)), 2).alias("spent"))


@R.query("count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_orderkey)::BIGINT AS orders FROM lineitem GROUP BY 1")
def count_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(n(F.countDistinct("l_partkey")).alias("parts"), n(F.countDistinct("l_orderkey")).alias("orders"))


@R.query("distinct_tokens", r"SELECT lang, count(DISTINCT w)::BIGINT AS tokens FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[ \n\t\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def distinct_tokens(t):
    """Tokens of a text are made distinct in its row, before they are shuffled."""
    w = t.documents.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), "[ \n\t\r]+"))).alias("w")).where("w <> ''")
    return w.groupBy("lang").agg(n(F.countDistinct("w")).alias("tokens"))


@R.query("bool_aggs", "SELECT o_custkey, bool_or(o_totalprice > 400000)::BIGINT AS any_big, bool_and(o_orderstatus <> 'P')::BIGINT AS none_late FROM orders GROUP BY 1")
def bool_aggs(t):
    return t.orders.groupBy("o_custkey").agg(n(F.bool_or(F.col("o_totalprice") > 400000)).alias("any_big"), n(F.bool_and(F.col("o_orderstatus") != "P")).alias("none_late"))


@R.query("minmax_dates", "SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def minmax_dates(t):
    g = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), n(F.count("*")).alias("n"))
    return g.select("o_custkey", text_of("a").alias("first"), text_of("b").alias("last"), "n")


@R.query("median_quantile", "SELECT o_orderpriority, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.1), 6) AS q10, round(quantile_cont(o_totalprice, 0.975), 6) AS q975 FROM orders GROUP BY 1")
def median_quantile(t):
    q = percentiles(t.orders, "o_totalprice", [0.5, 0.1, 0.975], ["o_orderpriority"], ["med", "q10", "q975"])
    return q.select("o_orderpriority", *[r6(c).alias(c) for c in ("med", "q10", "q975")])


@R.query("stddev_pop_samp", "SELECT user_id, round(stddev_pop(value), 6) AS pop, round(stddev_samp(value), 6) AS samp FROM events GROUP BY 1")
def stddev_pop_samp(t):
    return t.events.groupBy("user_id").agg(r6(F.stddev_pop("value")).alias("pop"), r6(F.stddev_samp("value")).alias("samp"))


@R.query("compound_return", "SELECT l_suppkey, round(product(1 + (l_discount - l_tax) / 10) - 1, 6) AS ret FROM lineitem GROUP BY 1")
def compound_return(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.product(1 + (F.col("l_discount") - F.col("l_tax")) / 10) - 1).alias("ret"))


_B = facts.BENFORD
_D = "substr(floor(abs(l_extendedprice))::BIGINT::VARCHAR, 1, 1)"


@R.query(
    "benford",
    f"""WITH d AS (SELECT l_suppkey, count(*) AS n, {", ".join(f"count(*) FILTER ({_D} = '{i + 1}') AS d{i}" for i in range(9))} FROM lineitem WHERE abs(l_extendedprice) >= 10 GROUP BY 1)
    SELECT l_suppkey, n::BIGINT AS n, CASE WHEN n >= 20 THEN round(({" + ".join(f"abs(d{i} / n - {b})" for i, b in enumerate(_B))}) / 9, 6) END AS mad,
    CASE WHEN n >= 20 THEN round(n * ({" + ".join(f"(d{i} / n - {b}) * (d{i} / n - {b}) / {b}" for i, b in enumerate(_B))}), 6) END AS chi2 FROM d""",
)
def benford(t):
    return facts.benford(t.lineitem, ["l_suppkey"], "l_extendedprice").select("l_suppkey", "n", r6("mad").alias("mad"), r6("chi2").alias("chi2"))


@R.query("round_share", "SELECT l_suppkey, CASE WHEN count(*) FILTER (abs(l_extendedprice) >= 10000) >= 10 THEN round(count(*) FILTER (abs(l_extendedprice) >= 10000 AND floor(l_extendedprice)::BIGINT % 1000 < 20) / count(*) FILTER (abs(l_extendedprice) >= 10000), 6) END AS share FROM lineitem GROUP BY 1")
def round_share(t):
    big = F.abs("l_extendedprice") >= 10000
    round_ = big & (F.floor("l_extendedprice").cast("long") % 1000 < 20)
    return t.lineitem.groupBy("l_suppkey").agg(F.when(F.count_if(big) >= 10, r6(F.count_if(round_) / F.count_if(big))).alias("share"))


@R.query("fact_shape", "SELECT l_orderkey, count(*)::BIGINT AS facts, count(DISTINCT CASE WHEN l_partkey > 100 THEN l_partkey END)::BIGINT AS custom, round(count(DISTINCT CASE WHEN l_partkey > 100 THEN l_partkey END) / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def fact_shape(t):
    own = F.countDistinct(F.when(F.col("l_partkey") > 100, F.col("l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(n(F.count("*")).alias("facts"), n(own).alias("custom"), r6(own / F.count("*")).alias("ratio"))


@R.query("net_fraction", "WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'purchase') AS b, sum(value) FILTER (event_type = 'error') AS e FROM events GROUP BY 1) SELECT user_id, round(coalesce((coalesce(b, 0) - coalesce(e, 0)) / nullif(coalesce(b, 0) + coalesce(e, 0), 0), 0), 6) AS net FROM s")
def net_fraction(t):
    of = lambda x: F.coalesce(F.sum(F.when(F.col("event_type") == x, F.col("value"))), F.lit(0.0))
    g = t.events.groupBy("user_id").agg(of("purchase").alias("b"), of("error").alias("e"))
    return g.select("user_id", r6(F.coalesce(F.try_divide(F.col("b") - F.col("e"), F.col("b") + F.col("e")), F.lit(0.0))).alias("net"))


@R.query(
    "array_stats",
    """WITH q AS (SELECT o_custkey AS k, list(v ORDER BY q) AS a FROM (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1)
    SELECT k, len(a)::BIGINT AS quarters, round(list_max(a) - list_min(a), 2) AS swing, round(list_stddev_pop(a) / nullif(abs(list_avg(a)), 0), 6) AS cv,
    len(list_filter(range(2, len(a)), lambda i: (a[i] - a[i - 1]) * (a[i + 1] - a[i]) < 0))::BIGINT AS turns FROM q""",
)
def array_stats(t):
    q = t.orders.groupBy(F.col("o_custkey").alias("k"), F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("v"))
    a = q.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("q", "v")))["v"].alias("a"), F.stddev_pop("v").alias("sd"), F.avg("v").alias("m"))
    turns = F.filter(F.sequence(F.lit(1), F.size("a") - 2), lambda i: (F.get("a", i) - F.get("a", i - 1)) * (F.get("a", i + 1) - F.get("a", i)) < 0)
    count = F.when(F.size("a") >= 3, F.size(turns)).otherwise(0)
    return a.select("k", n(F.size("a")).alias("quarters"), F.round(F.array_max("a") - F.array_min("a"), 2).alias("swing"), r6(F.try_divide(F.col("sd"), F.abs("m"))).alias("cv"), n(count).alias("turns"))


_FLAGS = "SELECT d.doc_id, l.toxic AS y, (contains(lower(d.text), 'licensed'))::INT AS licence, (length(d.text) > 2000)::INT AS long, (contains(d.text, '@'))::INT AS mail FROM documents d JOIN labels l USING (doc_id)"


def _flags(t):
    d = t.documents.join(t.labels, "doc_id")
    return d.select("doc_id", F.col("toxic").alias("y"), F.contains(F.lower("text"), F.lit("licensed")).cast("int").alias("licence"), (F.length("text") > 2000).cast("int").alias("long"), F.contains("text", F.lit("@")).cast("int").alias("mail"))


@R.query("flag_rates", f"SELECT flag, round(avg(v), 6) AS coverage, round(avg(CASE WHEN v = 1 THEN y END), 6) AS rate1, round(avg(CASE WHEN v = 0 THEN y END), 6) AS rate0 FROM (UNPIVOT ({_FLAGS}) ON licence, long, mail INTO NAME flag VALUE v) GROUP BY 1")
def flag_rates(t):
    u = _flags(t).unpivot(["y"], ["licence", "long", "mail"], "flag", "v")
    return u.groupBy("flag").agg(r6(F.avg("v")).alias("coverage"), r6(F.avg(F.when(F.col("v") == 1, F.col("y")))).alias("rate1"), r6(F.avg(F.when(F.col("v") == 0, F.col("y")))).alias("rate0"))


@R.query("enrichment", f"SELECT flag, round(avg(CASE WHEN y = 1 THEN v END) / nullif(avg(CASE WHEN y = 0 THEN v END), 0), 6) AS ratio FROM (UNPIVOT ({_FLAGS}) ON licence, long, mail INTO NAME flag VALUE v) GROUP BY 1")
def enrichment(t):
    u = _flags(t).unpivot(["y"], ["licence", "long", "mail"], "flag", "v")
    return u.groupBy("flag").agg(r6(F.try_divide(F.avg(F.when(F.col("y") == 1, F.col("v"))), F.avg(F.when(F.col("y") == 0, F.col("v"))))).alias("ratio"))


@R.query("crosstab", f"SELECT licence::BIGINT AS a, y::BIGINT AS b, count(*)::BIGINT AS n FROM ({_FLAGS}) GROUP BY 1, 2")
def crosstab(t):
    return _flags(t).groupBy(n("licence").alias("a"), n("y").alias("b")).agg(n(F.count("*")).alias("n"))


@R.query(
    "event_dedup_weight",
    """WITH e AS (SELECT l_orderkey AS k, l_linenumber, l_suppkey, min(l_shipdate::DATE) OVER (PARTITION BY l_orderkey) AS ev FROM lineitem)
    SELECT k, strftime(ev, '%Y-%m-%d') AS event, count(*)::BIGINT AS rows, round(1 / count(*), 6) AS weight FROM e GROUP BY 1, 2""",
)
def event_dedup_weight(t):
    """The first qualifying event of a group, its members, and a weight that makes them count once."""
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.min(day("l_shipdate")).alias("ev"), F.count("*").alias("c"))
    return g.select("k", text_of("ev").alias("event"), n("c").alias("rows"), r6(1 / F.col("c")).alias("weight"))


@R.query(
    "winsor_trim",
    """WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders GROUP BY 1)
    SELECT p, round(avg(least(greatest(o_totalprice, a), b)), 4) AS winsor, round(avg(o_totalprice) FILTER (o_totalprice BETWEEN a AND b), 4) AS trimmed, round(avg((o_totalprice > b)::INT), 6) AS tail FROM orders JOIN q ON p = o_orderpriority GROUP BY 1""",
)
def winsor_trim(t):
    q = percentiles(t.orders, "o_totalprice", [0.05, 0.95], ["o_orderpriority"], ["a", "b"]).withColumnRenamed("o_orderpriority", "p")
    v = F.col("o_totalprice")
    o = t.orders.join(q, F.col("p") == F.col("o_orderpriority"))
    return o.groupBy("p").agg(F.round(F.avg(F.least(F.greatest(v, "a"), "b")), 4).alias("winsor"), F.round(F.avg(F.when(v.between(F.col("a"), F.col("b")), v)), 4).alias("trimmed"), r6(F.avg((v > F.col("b")).cast("int"))).alias("tail"))


@R.query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY 1")
def correlation(t):
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("c"))


@R.query("rollup_year", "SELECT year(o_orderdate)::BIGINT AS y, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((year(o_orderdate)), ())")
def rollup_year(t):
    return t.orders.withColumn("y", n(F.year("o_orderdate"))).rollup("y").agg(n(F.count("*")).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@R.query("cube_counts", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (1, 2)")
def cube_counts(t):
    return t.orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).cube("s", "p").agg(n(F.count("*")).alias("n"))


@R.query("perf_summary", "WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS m, avg(o_totalprice) / 250000 - 1 AS r FROM orders GROUP BY 1, 2) SELECT p, round(avg(r) * 12, 6) AS mean, round(stddev_samp(r) * sqrt(12), 6) AS vol, round(avg(r) * 12 / nullif(stddev_samp(r) * sqrt(12), 0), 6) AS sharpe, round(avg((r > 0)::INT), 6) AS hit, round(min(r), 6) AS worst FROM m GROUP BY 1")
def perf_summary(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "MM").alias("m")).agg((F.avg("o_totalprice") / 250000 - 1).alias("r"))
    mean, vol = F.avg("r") * 12, F.stddev_samp("r") * F.sqrt(F.lit(12.0))
    return m.groupBy("p").agg(r6(mean).alias("mean"), r6(vol).alias("vol"), r6(F.try_divide(mean, vol)).alias("sharpe"), r6(F.avg((F.col("r") > 0).cast("int"))).alias("hit"), r6(F.min("r")).alias("worst"))


@R.query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_global(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@R.query("topk_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("i", F.row_number().over(w)).where("i <= 3").select("o_custkey", "o_orderkey")


@R.query("topk_after_agg", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS holders FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def topk_after_agg(t):
    return t.lineitem.groupBy("l_partkey").agg(n(F.countDistinct("l_suppkey")).alias("holders")).orderBy(F.desc("holders"), "l_partkey").limit(50)


@R.query("row_topk_reasons", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, array_to_string(list_transform(list_slice(list_reverse_sort([{'a': abs(l_quantity / 50), 'n': 'quantity'}, {'a': abs(l_discount * 10), 'n': 'discount'}, {'a': abs(l_tax * 12), 'n': 'tax'}]), 1, 2), lambda x: x.n), '; ') AS reasons FROM lineitem")
def row_topk_reasons(t):
    """The two features of greatest size in a row, by name."""
    parts = {"quantity": F.col("l_quantity") / 50, "discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12}
    each = F.array(*[F.struct(F.abs(v).alias("a"), F.lit(k).alias("n")) for k, v in parts.items()])
    return t.lineitem.select("l_orderkey", n("l_linenumber").alias("line"), "l_partkey", F.array_join(F.slice(F.sort_array(each, asc=False), 1, 2)["n"], "; ").alias("reasons"))


@R.query("quantile_cut", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.7) FROM orders)")
def quantile_cut(t):
    q = percentiles(t.orders, "o_totalprice", [0.7], names=["q"])
    return t.orders.crossJoin(F.broadcast(q)).where("o_totalprice >= q").select("o_orderkey")


@R.query("stratified_sample", "WITH l AS (SELECT doc_id, toxic, md5(doc_id::VARCHAR) AS h FROM labels), k AS (SELECT 3 * count(*) AS k FROM l WHERE toxic = 1) SELECT doc_id, toxic::BIGINT AS toxic FROM l QUALIFY toxic = 1 OR row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) <= (SELECT k FROM k)")
def stratified_sample(t):
    """All positives and three negatives for each, drawn by a hash of the key; the cut is a count per class, not a guess.

    Negatives are counted by the beginning of their hash first; only those with the beginning in which the cut falls are ordered.
    """
    from pyspark.sql import Window

    l = t.labels.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary"))).withColumn("b", F.substring("h", 1, 4))
    k = l.agg((3 * F.count_if(F.col("toxic") == 1)).alias("k"))
    per = l.where("toxic <> 1").groupBy("toxic", "b").agg(F.count("*").alias("c"))  # at most 65536 rows per class
    start = per.withColumn("before", F.sum("c").over(Window.partitionBy("toxic").orderBy("b")) - F.col("c")).crossJoin(F.broadcast(k)).where("before < k")
    near = l.join(F.broadcast(start), ["toxic", "b"])
    whole, cut = near.where("before + c <= k"), near.where("before + c > k")
    cut = cut.withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("toxic", "b").orderBy("h", "doc_id"))).where("i <= k")
    rows = l.where("toxic = 1").select("doc_id", "toxic").union(whole.select("doc_id", "toxic")).union(cut.select("doc_id", "toxic"))
    return rows.select("doc_id", n("toxic").alias("toxic"))


QUERIES, ORACLE_SQL = R.queries, R.sql
