"""Blocks of how firms file and of words against numbers. An order is a filing, its priority the form; a customer's text is the document of its number."""

from pyspark.sql import functions as F

from tidemark.operators import disclosure as D
from tidemark.operators import facts
from tidemark.plans.registry import Registry, day, n, r6
from tidemark.sources.writers import shared_folder

R = Registry()

_FORMS = {"1-URGENT": "10-K", "2-HIGH": "NT 10-K", "3-MEDIUM": "10-K/A", "4-NOT SPECIFIED": "8-K", "5-LOW": "10-Q/A"}
_COUNTS = ("late_notice", "notices_3y", "annual_amended_3y", "quarterly_amended_3y", "current_1y", "filings_1y")
_DOY = "(dayofyear({0}) + CASE WHEN month({0}) <= 5 THEN 365 ELSE 0 END)"


@R.query(
    "block_filing_behaviour",
    f"""WITH f AS (SELECT o_custkey AS firm, o_orderdate::DATE AS d, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORMS.items())} END AS form FROM orders),
    l AS (SELECT c_custkey AS entity, c_custkey AS firm, 0 AS place, DATE '1900-01-01' AS a, DATE '1995-06-30' AS b FROM customer UNION ALL SELECT c_custkey, c_custkey + 1, 1, DATE '1994-01-01', DATE '2100-01-01' FROM customer),
    p AS (SELECT l.*, year, NOT (a <= make_date(year, 12, 31) + 365 AND b >= make_date(year, 12, 31) - 365) AS far FROM l, range(1992, 1999) y(year)),
    k AS (SELECT firm, min(d) AS since, median({_DOY.format("d")}) FILTER (form = '10-K') AS m FROM f GROUP BY 1),
    c AS (SELECT entity, year, firm, far, place, since, m, (SELECT min(d) FROM f WHERE f.firm = p.firm AND form = '10-K' AND d >= make_date(p.year, 6, 1) AND d <= make_date(p.year + 1, 12, 31)) AS filed FROM p LEFT JOIN k USING (firm)),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY filed IS NULL, since IS NULL, far, place) = 1)
    SELECT entity, year, b.firm, any_value({_DOY.format("filed")})::DOUBLE AS doy, any_value({_DOY.format("filed")} - m)::DOUBLE AS lag_vs_median,
    CASE WHEN any_value(filed) IS NOT NULL THEN (count(*) FILTER (form = 'NT 10-K' AND filed - d <= 120) > 0)::BIGINT END AS late_notice,
    {", ".join(f"CASE WHEN any_value(filed) IS NOT NULL THEN count(*) FILTER ({cond}) END::BIGINT AS {k}" for k, cond in dict(notices_3y="form = 'NT 10-K'", annual_amended_3y="form = '10-K/A'", quarterly_amended_3y="form = '10-Q/A'", current_1y="form = '8-K' AND filed - d <= 365", filings_1y="filed - d <= 365").items())},
    round(any_value((filed - since) / 365.25), 6) AS firm_age, (any_value(filed) IS NULL)::BIGINT AS not_found FROM b LEFT JOIN f ON f.firm = b.firm AND f.d BETWEEN filed - 1095 AND filed GROUP BY 1, 2, 3""",
)
def block_filing_behaviour(t):
    """Each customer in each year, with itself and the next customer as the firms it may be."""
    form = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in _FORMS.items()])
    filings = t.orders.select(F.col("o_custkey").alias("firm"), day("o_orderdate").alias("day"), form.alias("form"))
    c, date = t.customer.select(F.col("c_custkey").alias("entity")), lambda s: F.lit(s).cast("date")
    own = c.select("entity", F.col("entity").alias("firm"), F.lit(0).alias("place"), date(None).alias("first"), date("1995-06-30").alias("last"))
    other = c.select("entity", (F.col("entity") + 1).alias("firm"), F.lit(1).alias("place"), date("1994-01-01").alias("first"), date(None).alias("last"))
    panel = c.withColumn("year", F.explode(F.sequence(F.lit(1992), F.lit(1998))))
    x = D.filing_behaviour(panel, own.unionByName(other), filings)
    return x.select("entity", n("year").alias("year"), "firm", "doy", F.col("lag_vs_median").cast("double").alias("lag_vs_median"), *[n(k).alias(k) for k in _COUNTS], r6("firm_age").alias("firm_age"), n("not_found").alias("not_found"))


@R.query(
    "block_auditor",
    """WITH o AS (SELECT *, o_orderdate::DATE AS d FROM orders), a AS (SELECT o_custkey AS firm, d AS e, o_orderkey % 40 AS auditor, o_orderkey % 3 AS partner, nullif(o_orderkey % 5, 0) AS participants, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS share,
    CASE WHEN o_orderkey % 7 > 0 THEN d + (o_orderkey % 90)::INT END AS signed, o_orderkey AS form FROM o WHERE o_orderpriority < '3'),
    r AS (SELECT *, lead(day) OVER w AS next, lag(rate) OVER w AS rate_before FROM (SELECT o_orderkey % 40 AS auditor, max(d) AS day, avg(o_totalprice) AS rate, count(*) AS reviewed, count(DISTINCT o_custkey) AS clients, year(d) % 2 AS annual FROM o WHERE o_orderpriority = '5-LOW' AND o_orderkey % 40 > 4 GROUP BY 1, year(d)) WINDOW w AS (PARTITION BY auditor ORDER BY day)),
    x AS (SELECT o_orderkey AS id, o_custkey AS k, d AS t, a.* FROM o LEFT JOIN a ON firm = o_custkey AND d - e BETWEEN 0 AND 400 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY e DESC, form DESC) = 1),
    y AS (SELECT x.*, b.auditor AS auditor0, b.partner AS partner0, b.firm IS NOT NULL AS had FROM x LEFT JOIN a b ON b.firm = k AND b.e < x.e - 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY b.e DESC, b.form DESC) = 1),
    s AS (SELECT auditor, year(e) + 1 AS y, count(*) AS audits FROM a GROUP BY 1, 2)
    SELECT id, round(rate, 2) AS rate, round(rate_before, 2) AS rate_before, round(rate - rate_before, 2) AS trend, reviewed, clients, annual, round((t - day) / 365.25, 6) AS years_since, CASE WHEN y.auditor IS NOT NULL THEN (day IS NULL)::BIGINT END AS never,
    CASE WHEN had THEN (y.auditor <> auditor0)::BIGINT END AS auditor_changed, CASE WHEN had THEN (partner <> partner0)::BIGINT END AS partner_changed, CASE WHEN e IS NOT NULL THEN coalesce(participants, 0) END AS participants, CASE WHEN e IS NOT NULL THEN coalesce(share, 0) END AS participant_share,
    (signed - e)::BIGINT AS report_lag, CASE WHEN e IS NOT NULL THEN coalesce(audits, 0) END AS auditor_audits FROM y LEFT JOIN r ON r.auditor = y.auditor AND t > day AND (next IS NULL OR t <= next) LEFT JOIN s ON s.auditor = y.auditor AND s.y = year(e)""",
)
def block_auditor(t):
    """Orders as filings; urgent ones carry the audit, slow ones of a year make an auditor's report; five auditors have none."""
    k, d = F.col("o_orderkey"), day("o_orderdate")
    audits = t.orders.where("o_orderpriority < '3'").select(
        F.col("o_custkey").alias("firm"), d.alias("period_end"), (k % 40).alias("auditor"), (k % 3).alias("partner"), F.when(k % 5 > 0, k % 5).alias("participants"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("share"),
        F.when(k % 7 > 0, F.date_add(d, (k % 90).cast("int"))).alias("signed"), k.alias("form"),
    )
    slow = t.orders.where("o_orderpriority = '5-LOW' AND o_orderkey % 40 > 4").groupBy((k % 40).alias("auditor"), F.year("o_orderdate").alias("y"))
    reports = slow.agg(F.max(d).alias("day"), F.avg("o_totalprice").alias("rate"), F.count("*").alias("reviewed"), F.count_distinct("o_custkey").alias("clients")).withColumn("annual", n(F.col("y") % 2))
    x = D.audit_history(t.orders.select(k.alias("id"), F.col("o_custkey").alias("firm"), d.alias("t")), audits, reports)
    r2 = lambda c: F.round(c, 2).alias(c)
    return x.select("id", r2("rate"), r2("rate_before"), r2("trend"), "reviewed", "clients", "annual", r6("years_since").alias("years_since"), "never", "auditor_changed", "partner_changed", "participants", "participant_share", "report_lag", "auditor_audits")


_SUMS = {
    "assets": "l_returnflag <> 'A'", "restructuring": "l_linenumber % 5 = 0", "deferred": "l_linenumber % 5 = 1", "pretax": "l_linestatus = 'O'",
    "foreign": "l_linenumber % 5 = 2", "current_tax": "l_linenumber % 5 = 3", "allowance": "l_returnflag = 'N'", "prior_allowance": "l_returnflag = 'R'",
}


@R.query(
    "block_determinants",
    f"""WITH v AS (SELECT l_orderkey AS id, {", ".join(f"sum(l_extendedprice) FILTER ({c}) AS {k}" for k, c in _SUMS.items())}, count(DISTINCT l_suppkey % 3) AS n_segments, count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END) AS n_geographies FROM lineitem GROUP BY 1),
    x AS (SELECT o_orderkey, o_orderdate::DATE AS d, min(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS a, v.*, assets > 0 AS big FROM orders LEFT JOIN v ON id = o_orderkey)
    SELECT o_orderkey AS id, round((d - a) / 365.25, 6) AS firm_age, coalesce(n_segments, 0) AS n_segments, coalesce(n_geographies, 0) AS n_geographies, CASE WHEN big THEN round(coalesce(restructuring, 0) / assets, 6) END AS restructuring, CASE WHEN big THEN round(deferred / assets, 6) END AS deferred,
    CASE WHEN big AND foreign_ IS NOT NULL AND pretax <> 0 THEN round(greatest(-2, least(2, foreign_ / abs(pretax))), 6) END AS foreign_share, CASE WHEN big THEN round((pretax - current_tax / 0.21) / assets, 6) + 0 END AS tax_gap, CASE WHEN big THEN round((allowance - prior_allowance) / assets, 6) + 0 END AS allowance_change,
    CASE WHEN big THEN (coalesce(foreign_, 0) <> 0)::BIGINT END AS has_foreign, CASE WHEN big THEN (coalesce(restructuring, 0) <> 0)::BIGINT END AS has_restructuring, CASE WHEN big THEN (coalesce(allowance, 0) <> 0)::BIGINT END AS has_allowance FROM x""".replace(" AS foreign,", " AS foreign_,"),
)
def block_determinants(t):
    """An order's lines as its facts: suppliers' numbers are segments, flags geographies. Sums of prices stand for items of the statements."""
    of = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(*[F.sum(F.when(F.expr(c), F.col("l_extendedprice"))).alias(k) for k, c in _SUMS.items()])
    parts = F.concat(F.lit("segments="), (F.col("l_suppkey") % 3).cast("string"), F.when(F.col("l_returnflag") != "A", F.concat(F.lit(";geography="), "l_returnflag")).otherwise(""))
    filings = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("firm"), day("o_orderdate").alias("filed"))
    x = facts.determinants(filings, of, t.lineitem.select(F.col("l_orderkey").alias("id"), parts.alias("parts")), filings.select("firm", F.col("filed").alias("day")), "segments=", "geography=")
    return x.select(*[c if c == "id" or c.startswith(("n_", "has_")) else r6(c).alias(c) for c in x.columns])


# Words of the given texts stand for words of good and bad news.
_GOOD, _BAD, _STRONG, _CLAIM, _ADJUSTED = "an", "en", "[Tt]h", "ion[.]", "[0-9][0-9]"
_W = "greatest(1, len(regexp_extract_all(text, '[A-Za-z]{2,}')))"
_MEASURES = ("upbeat_while_income_fell", "strong_words_while_loss", "growth_claim_revenue_fell", "adjusted_over_loss", "tone_minus_roa_rank", "effective_but_adverse", "effective_but_weakness", "effective_but_corrected", "effective_but_late", "effective_but_notice", "effective_but_letters", "quiet_but_distressed", "doubt_but_profitable")


@R.query(
    "block_contradiction",
    f"""WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS revenue, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS prior, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderstatus = 'P') AS part FROM orders GROUP BY 1),
    x AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS income, revenue, prior, (c_acctbal < 0)::INT AS loss, (revenue < prior)::INT AS neg, urgent, high, part, (part > 1)::INT AS ne, (high > 5)::INT AS gc, CASE WHEN text IS NOT NULL THEN (len(regexp_extract_all(text, '{_GOOD}')) - len(regexp_extract_all(text, '{_BAD}'))) / {_W} END AS tone,
    1000 * len(regexp_extract_all(text, '{_STRONG}')) / {_W} AS strong, regexp_matches(text, '{_CLAIM}')::INT AS claim, 1000 * len(regexp_extract_all(text, '{_ADJUSTED}')) / {_W} AS adjusted FROM customer LEFT JOIN o ON k = c_custkey LEFT JOIN documents ON doc_id = c_custkey),
    m AS (SELECT *, c_acct / revenue AS roa FROM (SELECT *, income AS c_acct FROM x)),
    r AS (SELECT k, (row_number() OVER (PARTITION BY g ORDER BY tone, k) - 1) / nullif(count(*) OVER (PARTITION BY g) - 1, 0) - (row_number() OVER (PARTITION BY g ORDER BY roa, k) - 1) / nullif(count(*) OVER (PARTITION BY g) - 1, 0) AS diff, count(*) OVER (PARTITION BY g) AS c FROM m WHERE tone IS NOT NULL AND roa IS NOT NULL),
    z AS (SELECT m.*, CASE WHEN c >= 11 THEN diff END AS diff, tone > median(tone) OVER (PARTITION BY g) AS upbeat FROM m LEFT JOIN r USING (k))
    SELECT k AS custkey, round(tone, 6) + 0 AS tone, (upbeat AND coalesce((revenue - prior) / greatest(1, abs(prior)) < -0.1, false))::DOUBLE AS upbeat_while_income_fell, round(strong * loss, 6) AS strong_words_while_loss, (claim * coalesce((revenue - prior) / greatest(1, abs(prior)) < -0.05, false)::INT)::DOUBLE AS growth_claim_revenue_fell,
    round(adjusted * loss, 6) AS adjusted_over_loss, round(diff, 6) + 0 AS tone_minus_roa_rank, ((1 - ne) * neg)::DOUBLE AS effective_but_adverse, ((1 - ne) * coalesce(urgent > 3, false)::INT)::DOUBLE AS effective_but_weakness, ((1 - ne) * coalesce(high > 3, false)::INT)::DOUBLE AS effective_but_corrected, ((1 - ne) * coalesce(part > 0, false)::INT)::DOUBLE AS effective_but_late,
    ((1 - ne) * coalesce(high > 2, false)::INT)::DOUBLE AS effective_but_notice, ((1 - ne) * coalesce(urgent > 1, false)::INT)::DOUBLE AS effective_but_letters, ((1 - gc) * (coalesce(neg > 0 AND loss > 0 AND k % 10 < 5, false))::INT)::DOUBLE AS quiet_but_distressed, (gc * coalesce(loss = 0 AND neg = 0, false)::INT)::DOUBLE AS doubt_but_profitable FROM z WHERE tone IS NOT NULL""",
)
def block_contradiction(t):
    """Customers with a text; nations stand for years, and revenue for income where it is compared with the year before."""
    of = lambda year: F.sum(F.when(F.year("o_orderdate") == year, F.col("o_totalprice")))
    count = lambda c: F.count(F.when(c, 1))
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        of(1997).alias("revenue"), of(1996).alias("prior_revenue"), count(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        count(F.col("o_orderpriority") == "2-HIGH").alias("high"), count(F.col("o_orderstatus") == "P").alias("part"),
    )
    text, words = F.col("text"), F.greatest(F.regexp_count("text", F.lit("[A-Za-z]{2,}")), F.lit(1))
    found = lambda p: F.regexp_count(text, F.lit(p))
    d = t.documents.select(
        F.col("doc_id").alias("k"), ((found(_GOOD) - found(_BAD)) / words).alias("tone"), (1000 * found(_STRONG) / words).alias("strong"),
        text.rlike(_CLAIM).cast("int").alias("growth_claim"), (1000 * found(_ADJUSTED) / words).alias("adjusted"),
    )
    x = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("year"), F.col("c_acctbal").alias("balance")).join(o, "k", "left").join(d, "k", "left")
    loss, fell, is_ = F.col("balance") < 0, F.col("revenue") < F.col("prior_revenue"), lambda c: c.cast("int")
    x = x.withColumns(
        {
            "income": F.col("revenue"), "prior_income": F.col("prior_revenue"), "roa": F.try_divide("balance", "revenue"), "loss": is_(loss), "negative_equity": is_(fell),
            "cash_ratio": F.col("k") % 10 / 100, "late_days": F.col("part"), "not_effective": is_(F.col("part") > 1), "adverse": is_(fell), "weaknesses": F.greatest(F.col("urgent") - 3, F.lit(0)),
            "going_concern": is_(F.col("high") > 5), "corrections": F.greatest(F.col("high") - 3, F.lit(0)), "notices_2y": F.greatest(F.col("high") - 2, F.lit(0)), "letters_1y": F.greatest(F.col("urgent") - 1, F.lit(0)),
        }
    )
    # Measures of whole texts are read several times by the ranks, so they are written once.
    folder = shared_folder(t.spark)
    x.write.parquet(folder)
    c = D.contradictions(t.spark.read.parquet(folder), "k", "year").where("tone is not null")
    return c.select(F.col("k").alias("custkey"), *[r6(k).alias(k) for k in ("tone", *_MEASURES)])


QUERIES, ORACLE_SQL = R.queries, R.sql
