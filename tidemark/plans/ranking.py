"""Metrics and resampling. Scores are text statistics of labelled documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import ranks as K
from tidemark.plans.registry import Registry, n, r6

R = Registry()

_S = "SELECT d.doc_id, d.lang, d.source, l.toxic AS y, n_chars::DOUBLE AS a, floor(n_chars / 200)::DOUBLE AS b, (doc_id * 7919 % 1000)::DOUBLE AS c FROM documents d JOIN labels l USING (doc_id)"


_SN = f"SELECT doc_id, y, CASE WHEN a < 4000 THEN a END AS a, b, CASE WHEN doc_id % 7 <> 0 THEN c END AS c FROM ({_S})"


def _scores(t):
    d = t.documents.join(t.labels, "doc_id")
    c = F.col("n_chars")
    return d.select("doc_id", "lang", "source", F.col("toxic").alias("y"), c.cast("double").alias("a"), F.floor(c / 200).cast("double").alias("b"), (F.col("doc_id") * 7919 % 1000).cast("double").alias("c"))


def _auc_sql(score, by="", src=f"({_S})"):
    """The average-rank form, other than the one computed."""
    over, group = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    rank = f"SELECT {group}y, rank() OVER ({over}ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}{score}) - 1) / 2 AS r FROM {src}"
    return f"SELECT {group}count(*)::BIGINT AS n, sum(y)::BIGINT AS pos, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM ({rank})" + (f" GROUP BY {by}" if by else "")


@R.query("auc", _auc_sql("b"))
def auc(t):
    return M.auc(_scores(t), "b", "y").select(n("n").alias("n"), n("pos").alias("pos"), r6("auc").alias("auc"))


@R.query("auc_by_year", _auc_sql("b", "lang"))
def auc_by_year(t):
    """One metric per group, here the language."""
    return M.auc(_scores(t), "b", "y", ["lang"]).select("lang", n("n").alias("n"), n("pos").alias("pos"), r6("auc").alias("auc"))


@R.query("auc_drop_year", _auc_sql("b", "left_out", f"(SELECT s.*, g.lang AS left_out FROM ({_S}) s JOIN (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)) g ON g.lang IS DISTINCT FROM s.lang WHERE g.lang IS NOT NULL)"))
def auc_drop_year(t):
    """The metric with each group left out in turn, here the language."""
    return M.auc_without(_scores(t), "b", "y", "lang").select("left_out", n("n").alias("n"), n("pos").alias("pos"), r6("auc").alias("auc"))


_SPLIT = "SELECT o_custkey % 997 AS k, o_totalprice AS v, (o_orderstatus = 'F')::INT AS y, o_orderdate < TIMESTAMP '1995-09-01' AS train FROM orders"


@R.query(
    "leak_disjoint",
    f"WITH o AS ({_SPLIT}), e AS (SELECT k, max(y) AS hit FROM o WHERE train GROUP BY 1), s AS (SELECT v, y, hit FROM o LEFT JOIN e USING (k) WHERE NOT train), "
    "u AS (SELECT 'all' AS subset, v, y FROM s UNION ALL SELECT 'no_positive', v, y FROM s WHERE coalesce(hit, 0) = 0 UNION ALL SELECT 'new', v, y FROM s WHERE hit IS NULL) " + _auc_sql("v", "subset", "u"),
)
def leak_disjoint(t):
    """The metric on later orders, on those of customers without an earlier positive, and on those of customers never seen before."""
    o = t.orders.select((F.col("o_custkey") % 997).alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1995-09-01").cast("timestamp")
    return M.auc_of_new(o.where(early), o.where(~early), "v", "y", "k").select("subset", n("n").alias("n"), n("pos").alias("pos"), r6("auc").alias("auc"))


@R.query("auc_per_feature", f"SELECT feature, coverage, auc FROM ({_auc_sql('v', 'feature', f'(UNPIVOT ({_SN}) ON a, b, c INTO NAME feature VALUE v)')}) JOIN (SELECT unnest(['a', 'b', 'c']) AS feature, round(unnest([count(a) / count(*), count(b) / count(*), count(c) / count(*)]), 6) AS coverage FROM ({_SN})) USING (feature)")
def auc_per_feature(t):
    """Each feature over the rows that have it; here one lacks values of long texts, another of every seventh row."""
    s = _scores(t).withColumns({"a": F.when(F.col("a") < 4000, F.col("a")), "c": F.when(F.col("doc_id") % 7 != 0, F.col("c"))})
    return M.auc_per_feature(s, ["a", "b", "c"], "y").select("feature", r6("coverage").alias("coverage"), r6("auc").alias("auc"))


@R.query("precision_at_k", f"WITH s AS ({_S}), k AS (SELECT y FROM s ORDER BY a DESC, doc_id LIMIT 100) SELECT count(*)::BIGINT AS k, sum(y)::BIGINT AS hits, round(avg(y), 6) AS precision, round(avg(y) / nullif((SELECT avg(y) FROM s), 0), 6) AS lift FROM k")
def precision_at_k(t):
    return M.precision_at(_scores(t), "a", "y", "doc_id", 100).select("k", "hits", r6("precision").alias("precision"), r6("lift").alias("lift"))


@R.query(
    "ndcg",
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY a DESC, doc_id) AS i FROM ({_S})), k AS (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT AS k, sum(y)::BIGINT AS p FROM s)
    SELECT k, round((SELECT sum(y / log2(i + 1)) FROM s WHERE i <= k) / (SELECT sum(1 / log2(j + 1)) FROM (SELECT unnest(range(1, least(k.k, k.p) + 1)) AS j)), 6) AS ndcg FROM k""",
)
def ndcg(t):
    return M.ndcg(_scores(t), "a", "y", "doc_id", 0.1).select("k", r6("ndcg").alias("ndcg"))


def _told(values, value):
    return M.interval(values, value).select(r6("lo").alias("lo"), r6("hi").alias("hi"), r6("p_le_0").alias("p_le_0"))


def _draws(unit):
    u = f"('0x' || substr(md5('0|' || {unit} || '|' || r), 1, 10))::BIGINT::DOUBLE / {1 << 40}"
    return f"SELECT *, {' + '.join(f'CASE WHEN u >= {e!r} THEN 1.0::DOUBLE ELSE 0 END' for e in M.POISSON_EDGES)} AS w FROM (SELECT s.*, r, {u} AS u FROM ({_S}) s, range(1, 101) t(r))"


def _boot_sql(unit, *scores):
    """Weighted sums below each score by a plain window; the difference of two scores is paired by replicate."""
    each = [f"{m}1 AS (SELECT r, {m} AS v, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y <> 1), 0) AS neg FROM d WHERE w > 0 GROUP BY 1, 2), {m}2 AS (SELECT r, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {m}1) GROUP BY 1)" for m in scores]
    value = " - ".join(f"{m}2.auc" for m in scores)
    return f"WITH d AS ({_draws(unit)}), {', '.join(each)}, x AS (SELECT {value} AS d FROM {' JOIN '.join(f'{m}2' + (' USING (r)' if i else '') for i, m in enumerate(scores))}) {_INTERVAL}"


_INTERVAL = "SELECT round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d <= 0)::INT), 6) AS p_le_0 FROM x"


@R.query("bootstrap_ci", _boot_sql("doc_id", "a"))
def bootstrap_ci(t):
    return _told(M.bootstrap_auc(_scores(t), ["a"], "y", "doc_id", 100), "a")


@R.query("paired_bootstrap", _boot_sql("doc_id", "a", "c"))
def paired_bootstrap(t):
    return _told(M.bootstrap_auc(_scores(t), ["a", "c"], "y", "doc_id", 100).withColumn("d", F.col("a") - F.col("c")), "d")


@R.query("cluster_bootstrap", _boot_sql("source", "a", "c"))
def cluster_bootstrap(t):
    """Whole sources are drawn, as their documents are alike."""
    return _told(M.bootstrap_auc(_scores(t), ["a", "c"], "y", "source", 100).withColumn("d", F.col("a") - F.col("c")), "d")


@R.query("bootstrap_diff", f"WITH x AS (SELECT r, sum(w * a) FILTER (y = 1) / nullif(sum(w) FILTER (y = 1), 0) - sum(w * a) FILTER (y = 0) / nullif(sum(w) FILTER (y = 0), 0) AS d FROM ({_draws('doc_id')}) GROUP BY 1) {_INTERVAL}")
def bootstrap_diff(t):
    """The difference of two groups' means under resampling."""
    d = _scores(t).select("doc_id", "y", "a").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(100))))
    w = d.withColumn("w", M.poisson_weight(F.col("doc_id"), F.col("replicate")))
    of = lambda y: F.try_divide(F.sum(F.when(F.col("y") == y, F.col("w") * F.col("a"))), F.sum(F.when(F.col("y") == y, F.col("w"))))
    return _told(w.groupBy("replicate").agg((of(1) - of(0)).alias("d")), "d")


_H = "SELECT s.*, md5(d.text) AS h FROM ({0}) s JOIN documents d USING (doc_id)".format(_S)


@R.query("leak_audit", f"WITH h AS ({_H}), e AS (SELECT h, min(doc_id) AS early FROM h WHERE y = 1 GROUP BY 1), s AS (SELECT h.*, CASE WHEN a < 500 THEN 'short' WHEN a < 3000 THEN 'middle' ELSE 'long' END AS bucket FROM h LEFT JOIN e USING (h) WHERE early IS NULL OR doc_id <= early) " + _auc_sql("c", "bucket", "s"))
def leak_audit(t):
    """The metric by bucket, over rows whose text had no positive before."""
    s = _scores(t).join(t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), "doc_id")
    early = s.where("y = 1").groupBy("h").agg(F.min("doc_id").alias("early"))
    s = s.join(early, "h", "left").where("early is null or doc_id <= early").withColumn("bucket", F.when(F.col("a") < 500, "short").when(F.col("a") < 3000, "middle").otherwise("long"))
    return M.auc(s, "c", "y", ["bucket"]).select("bucket", n("n").alias("n"), n("pos").alias("pos"), r6("auc").alias("auc"))


_U = "(row_number() OVER (PARTITION BY lang ORDER BY {0}, doc_id) - 1) / nullif(count(*) OVER (PARTITION BY lang) - 1, 0)"


@R.query("rank_blend", f"SELECT doc_id, round(0.7 * {_U.format('a')} + 0.3 * {_U.format('c')}, 6) AS blend FROM ({_S})")
def rank_blend(t):
    u = K.with_rank_unit(K.with_rank_unit(_scores(t), ["lang"], "a", "doc_id", "ua"), ["lang"], "c", "doc_id", "uc")
    return u.select("doc_id", r6(0.7 * F.col("ua") + 0.3 * F.col("uc")).alias("blend"))


@R.query("score_average", f"SELECT lang, round(avg((a + b + c) / 3), 6) AS m FROM ({_S}) GROUP BY 1")
def score_average(t):
    return _scores(t).groupBy("lang").agg(r6(F.avg((F.col("a") + F.col("b") + F.col("c")) / 3)).alias("m"))


@R.query("cascade_rank", f"WITH u AS (SELECT *, {_U.format('a')} AS u FROM ({_S})) SELECT doc_id, round(CASE WHEN u >= 0.7 THEN 0.7 + 0.3 * (row_number() OVER (PARTITION BY lang, u >= 0.7 ORDER BY c, doc_id) - 1) / nullif(count(*) OVER (PARTITION BY lang, u >= 0.7) - 1, 0) ELSE u END, 6) AS s FROM u")
def cascade_rank(t):
    """A second score orders the top three tenths of the first."""
    u = K.with_rank_unit(_scores(t), ["lang"], "a", "doc_id", "u").withColumn("top", F.col("u") >= 0.7)
    return K.with_rank_unit(u, ["lang", "top"], "c", "doc_id", "u2").select("doc_id", r6(F.when(F.col("top"), 0.7 + 0.3 * F.col("u2")).otherwise(F.col("u"))).alias("s"))


@R.query("select_by_validation", f"""WITH s AS (SELECT *, doc_id % 4 AS fold FROM ({_S})), l AS (UNPIVOT s ON a, b, c INTO NAME model VALUE v), m AS (SELECT fold, model, avg(v) FILTER (y = 1) / nullif(avg(v) FILTER (y = 0), 0) AS m FROM l GROUP BY 1, 2)
    SELECT model, count(*) FILTER (win)::BIGINT AS wins, (count(*) FILTER (win) >= 3)::BIGINT AS chosen FROM (SELECT *, m = max(m) OVER (PARTITION BY fold) AS win FROM m) GROUP BY 1""")
def select_by_validation(t):
    """A model is chosen if it wins in three of four folds."""
    l = _scores(t).withColumn("fold", F.col("doc_id") % 4).unpivot(["fold", "y"], ["a", "b", "c"], "model", "v")
    of = lambda y: F.avg(F.when(F.col("y") == y, F.col("v")))
    m = l.groupBy("fold", "model").agg(F.try_divide(of(1), of(0)).alias("m"))
    m = m.withColumn("win", F.col("m") == F.max("m").over(Window.partitionBy("fold")))
    return m.groupBy("model").agg(n(F.count_if("win")).alias("wins"), n(F.count_if("win") >= 3).alias("chosen"))


QUERIES, ORACLE_SQL = R.queries, R.sql
