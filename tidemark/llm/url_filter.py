"""URL filter: fixed host and path rules first, then the host's reputation by empirical Bayes.

Labelled pages count as good or bad outcomes of their host. The beta-binomial prior of a host comes from its registered
domain, that of a domain from its suffix, and that of a suffix from all pages; at each level the prior's weight (its number of
pseudo-outcomes) is fitted from how far the rates of the level's members spread. A host is blocked if the posterior, a beta
distribution, leaves almost no chance that its rate of good pages reaches a minimum, that is, only on evidence; an unknown host
inherits its domain's standing. Where the rates of hosts spread no more than by chance, weights are high and no host stands out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, let, sized, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): a host and, from the first slash, the path's beginning.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A host is blocked if its rate of good pages lies below MIN_GOOD with a posterior probability of SURE or more.
MIN_GOOD, SURE = 0.5, 0.95
#: Suffixes of two labels under which names are registered; others are last labels. A caller passes its own list.
COMPOUND_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.tr", "com.tw", "co.za")
#: Terms of the continued fraction of the incomplete beta function.
BETA_TERMS = 120
#: Bounds on a prior's weight; the first also where nothing can be fitted.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path: null urls and urls without :// have neither."""
    rest = F.when(F.col(url_col).contains("://"), F.regexp_replace(F.col(url_col), r"^(?s).*?://", "")).otherwise(F.lit(""))
    head = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"(?s)[?#].*$", "")
    return df.withColumns({"host": F.translate(head, UPPER, LOWER), "path": path})


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones the first by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix(host: Column, compound: tuple[str, ...] = COMPOUND_SUFFIXES) -> Column:
    """The last label, or the last two if they are a suffix together and a name stands before them; of numeric addresses none."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), F.lit("")).when(two.isin(*compound) & (two != host), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, compound: tuple[str, ...] = COMPOUND_SUFFIXES) -> Column:
    """The suffix and the label before it; of numeric addresses and single labels, the host itself."""
    labels = F.when(suffix(host, compound).contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(labels)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series ten steps up, exact to about twelve digits."""
    def series(y: Column) -> Column:
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))

    return let(x, lambda v: series(v + 10) - sum((F.log(v + i) for i in range(1, 10)), F.log(v)))


def beta_cdf(x: float, a: Column, b: Column) -> Column:
    """P(X <= x) for X ~ Beta(a, b), a and b > 0: the regularised incomplete beta function, by its continued fraction.

    The fraction converges fast below the mean; above it the other tail is taken.
    """
    tiny = 1e-300
    far = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def tail(p: Column, q: Column, z: Column) -> Column:
        def term(s: Column, m: Column) -> Column:
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            one = lambda s, k: let(F.struct(far(1 + k * s["d"]).alias("d"), far(1 + k / s["c"]).alias("c")), lambda t: F.struct((1 / t["d"]).alias("d"), t["c"].alias("c"), (s["h"] * t["c"] / t["d"]).alias("h")))
            return let(one(s, even), lambda t: one(t, odd))

        first = 1 / far(1 - (p + q) * z / (p + 1))
        start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
        steps = F.transform(F.sequence(F.lit(1), F.lit(BETA_TERMS)), lambda m: m.cast("double"))
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log(1 - z)) / p
        return front * F.aggregate(steps, start, term, lambda s: s["h"])

    low = F.lit(x) < (a + 1) / (a + b + 2)
    turned = F.struct(F.when(low, a).otherwise(b).alias("p"), F.when(low, b).otherwise(a).alias("q"), F.when(low, F.lit(x)).otherwise(F.lit(1 - x)).alias("z"))
    return let(let(turned, lambda v: tail(v["p"], v["q"], v["z"])), lambda v: F.when(low, v).otherwise(1 - v))


def _weight(members: DataFrame, by: str | None) -> DataFrame:
    """Per group of `by` (or once): pooled counts and the prior weight that the spread of the members' rates bears out.

    Moments: with n outcomes at rate p the rate of a member varies by m(1-m)/n from chance alone; what it varies beyond that
    is m(1-m)/(w+1) for a prior of weight w.
    """
    # Sums of squares: sum n p^2 = sum good^2 / n, so one pass of plain sums is enough.
    sums = [
        F.sum("n").alias("N"), F.sum("good").alias("G"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.try_divide(F.col("good").cast("double") * F.col("good"), F.col("n"))).alias("q"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ]
    g = (members.groupBy(by) if by else members.groupBy()).agg(*sums)
    g = g.withColumn("m", F.coalesce(F.try_divide(F.col("G"), F.col("N")), F.lit(0.5)))
    chance = F.col("m") * (1 - F.col("m"))
    between = (F.col("q") - F.col("N") * F.col("m") * F.col("m") - (F.col("k") - 1) * chance) / (F.col("N") - F.try_divide(F.col("nn"), F.col("N")))
    over = F.when((F.col("k") >= 2) & (F.col("N") * F.col("N") > F.col("nn")), between)
    w = F.when(over > 0, chance / over - 1).when(over <= 0, F.lit(MOST_WEIGHT)).otherwise(F.lit(LEAST_WEIGHT))
    return g.withColumn("w", F.round(F.least(F.greatest(w, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)), 6))


def host_reputation(labelled: DataFrame, min_good: float = MIN_GOOD) -> DataFrame:
    """labelled: host, n labelled pages, good ones among them (longs), a row per host, unlabelled hosts too.

    Gives host, n_labelled, n_good, post_mean, p_below: the posterior probability that the host's rate of good pages is below
    min_good. Weights are fitted once per level over all members, so a domain with a single host still gets a weight; counts are
    pooled per domain and suffix. All work is on one row per host.
    """
    hosts = labelled.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    pool = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*pool)
    suffixes = domains.groupBy("suffix").agg(*pool)
    # One row each: the weights of the three levels.
    level = [_weight(x, None).select(F.col("w").alias(name), F.col("m").alias(f"{name}_m")) for x, name in ((suffixes, "w_suffix"), (domains, "w_domain"), (hosts, "w_host"))]
    weights = F.broadcast(keep(level[0].crossJoin(level[1]).crossJoin(level[2]), "weights"))

    def shrunk(prior: Column, w: Column) -> Column:
        return F.round((prior * w + F.col("good")) / (w + F.col("n")), 9)

    s = suffixes.crossJoin(weights).select("suffix", shrunk(F.col("w_suffix_m"), F.col("w_suffix")).alias("m_suffix"))
    d = domains.join(s, "suffix").crossJoin(weights).select("domain", "suffix", shrunk(F.col("m_suffix"), F.col("w_domain")).alias("m_domain"))
    h = hosts.join(d, ["domain", "suffix"]).crossJoin(weights).withColumn("post_mean", shrunk(F.col("m_domain"), F.col("w_host")))
    # The prior keeps a little of both outcomes, so that the posterior is a proper beta distribution.
    mean = F.least(F.greatest(F.col("m_domain"), F.lit(1e-6)), F.lit(1 - 1e-6))
    below = beta_cdf(min_good, mean * F.col("w_host") + F.col("good"), (1 - mean) * F.col("w_host") + F.col("n") - F.col("good"))
    return h.select("host", F.col("n").alias("n_labelled"), F.col("good").alias("n_good"), "post_mean", (F.round(below, 6) + F.lit(0.0)).alias("p_below"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, sure: float = SURE) -> DataFrame:
    """A row per row of pages (page_id, url): page_id, host, path, rule, verdict, n_labelled, n_good, post_mean, p_below.

    outcomes: page_id, good (boolean; null: no outcome); of repeated ids a page is good only if all outcomes are. A null url
    has an empty host, which has a reputation like any other. A null page_id has no outcome. Repeated rows each count. Tables
    without outcomes give the prior 0.5 and block nothing. Further columns of either table are not read.
    """
    pages = split_url(pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")), "url").drop("url")
    outcomes = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    judged = pages.select("page_id", "host").join(outcomes, "page_id", "left")
    # Counts per host meet before they are dealt out, so a host with a third of all pages sends a row per task.
    per_host = keep(judged.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good")), "hosts")
    known = sized(keep(host_reputation(per_host, min_good), "reputation"))
    out = pages.join(known, "host", "left").withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("p_below") >= sure, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "n_labelled", "n_good", "post_mean", "p_below")


def op1_url_filter(spark, sf_dir):
    """Every page; the labels of the document with the page's id are its outcome: good if of good quality and not toxic."""
    good = F.col("quality").eqNullSafe(1) & ~F.col("toxic").eqNullSafe(1)
    known = F.coalesce("quality", "toxic").isNotNull()
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(known, good).alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)


QUERIES = {"op1_url_filter": op1_url_filter}


def _sql_weight(name: str, members: str) -> str:
    return f"""
{name} AS (SELECT round(least(greatest(CASE WHEN k >= 2 AND N * N > nn THEN CASE WHEN o > 0 THEN m * (1 - m) / o - 1 ELSE 1000.0 END
    ELSE 2.0 END, 2.0), 1000.0), 6) AS w, m FROM (
  SELECT *, CASE WHEN k >= 2 AND N * N > nn THEN (q - N * m * m - (k - 1) * m * (1 - m)) / (N - nn / N) END AS o FROM (
    SELECT *, CASE WHEN N > 0 THEN G / N ELSE 0.5 END AS m FROM (
      SELECT sum(n)::DOUBLE AS N, sum(good)::DOUBLE AS G, count(*) FILTER (n > 0) AS k,
        sum(CASE WHEN n > 0 THEN good::DOUBLE * good / n END) AS q, sum(n::DOUBLE * n) AS nn FROM {members}))))"""


_COMPOUND_RE = r"[^.]*\.(" + "|".join(c.replace(".", r"\.") for c in COMPOUND_SUFFIXES) + ")$"

ORACLE_SQL = {
    "op1_url_filter": rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(url, '^(?s).*?://', '') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)[?#].*$', '') AS path FROM u),
l AS (SELECT doc_id, min(quality IS NOT DISTINCT FROM 1 AND toxic IS DISTINCT FROM 1) AS good FROM labels
  WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host WHEN regexp_matches(host, '{_COMPOUND_RE}') THEN regexp_extract(host, '([^.]*\.){{2}}[^.]*$') ELSE regexp_extract(host, '([^.]*\.)?[^.]*$') END AS domain,
  CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN '' WHEN regexp_matches(host, '{_COMPOUND_RE}') THEN regexp_extract(host, '[^.]*\.[^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix,
  count(good) AS n, count(*) FILTER (good) AS good FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
{_sql_weight("ws", "suffixes")}, {_sql_weight("wd", "domains")}, {_sql_weight("wh", "hosts")},
s AS (SELECT suffix, round((ws.m * ws.w + good) / (ws.w + n), 9) AS m FROM suffixes, ws),
d AS (SELECT domain, suffix, round((s.m * wd.w + good) / (wd.w + n), 9) AS m FROM wd, domains JOIN s USING (suffix)),
h AS (SELECT host, n, good, round((d.m * wh.w + good) / (wh.w + n), 9) AS pm, least(greatest(d.m, 1e-6), 1 - 1e-6) * wh.w + good AS a,
  (1 - least(greatest(d.m, 1e-6), 1 - 1e-6)) * wh.w + n - good AS z FROM wh, hosts JOIN d USING (domain, suffix)),
v AS (SELECT *, {MIN_GOOD} < (a + 1) / (a + z + 2) AS low FROM h),
cf AS (SELECT host, CASE WHEN low THEN a ELSE z END AS p, CASE WHEN low THEN z ELSE a END AS q, CASE WHEN low THEN {MIN_GOOD}::DOUBLE ELSE 1 - {MIN_GOOD}::DOUBLE END AS x, 0 AS i, 0::DOUBLE AS f FROM v
  -- The fraction from its last term inwards.
  UNION ALL SELECT host, p, q, x, i + 1, (CASE WHEN k % 2 = 0 THEN (k // 2) * (q - k // 2) * x / ((p + k - 1) * (p + k)) ELSE -(p + k // 2) * (p + q + k // 2) * x / ((p + k - 1) * (p + k)) END) / (1 + f)
  FROM (SELECT *, {2 * BETA_TERMS} - i AS k FROM cf WHERE i < {2 * BETA_TERMS})),
b AS (SELECT v.host, n, good, pm, round(CASE WHEN low THEN t ELSE 1 - t END, 6) + 0 AS up FROM v JOIN (
  SELECT host, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p / (1 + f) AS t FROM cf WHERE i = {2 * BETA_TERMS}) USING (host)),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}) t(verdict, rule, rhost, rpath)),
x AS (SELECT p.host, p.path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY 1, 2)
SELECT p.page_id, p.host, p.path, x.rule, coalesce(x.verdict, CASE WHEN b.up >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict,
  b.n AS n_labelled, b.good AS n_good, b.pm AS post_mean, b.up AS p_below
FROM p JOIN b USING (host) LEFT JOIN x ON x.host = p.host AND x.path = p.path
""",
}
