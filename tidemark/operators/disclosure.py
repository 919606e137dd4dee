"""How a firm files, who audits it, and where its words disagree with its numbers. All is as of the filing's day."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators import temporal as T
from tidemark.operators.metrics import percentiles

# Forms, as filings name them.
ANNUAL = ("10-K", "10-K405", "10-KSB", "10KSB", "20-F", "40-F")
ANNUAL_AMENDED = ("10-K/A", "10-K405/A", "10-KSB/A", "10KSB/A", "20-F/A", "40-F/A")
QUARTERLY_AMENDED = ("10-Q/A", "10QSB/A")


def shifted_day(day: Column) -> Column:
    """The day of the year; January to May count as days 366 and on, so that filings of one fiscal year sort together."""
    return F.dayofyear(day) + F.when(F.month(day) <= 5, 365).otherwise(0)


def filing_behaviour(panel: DataFrame, links: DataFrame, filings: DataFrame) -> DataFrame:
    """A row per entity and year of panel that has a link: entity, year, firm, doy, lag_vs_median, late_notice, notices_3y, annual_amended_3y,
    quarterly_amended_3y, current_1y, filings_1y, firm_age and not_found.

    panel: entity, year (distinct); links: entity, firm, place, first, last (null: open); filings: firm, day, form. Of an entity's firms, those
    whose link holds within a year of the year's end come first, then by place; the first one with an annual report from June 1 of the
    year to the end of the next one is taken, and its first such report is the filing. Counts are of the 365 and 1095 days up to that day
    and the day itself (a late notice: 120 days). lag_vs_median is against the firm's own median. Where no firm has a report, not_found is 1, all
    measures are null, and the firm is the first that filed anything, else the first. Null firms, days and forms are left out.

    A report belongs to at most two years, so reports meet years by equality; windows are range frames over the union of both sides.
    """
    f = filings.select("firm", F.col("day").cast("date").alias("day"), "form").dropna()
    annual = f.where(F.col("form").isin(*ANNUAL)).select("firm", "day", shifted_day(F.col("day")).alias("doy"))
    fits = F.array_compact(F.array(F.year("day") - 1, F.when(F.month("day") >= 6, F.year("day"))))
    reports = annual.select("firm", "day", F.explode(fits).alias("year")).groupBy("firm", "year").agg(F.min("day").alias("filed"))
    end = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    near = (F.coalesce("first", F.lit("1900-01-01").cast("date")) <= F.date_add(end, 365)) & (F.coalesce("last", F.lit("2100-01-01").cast("date")) >= F.date_sub(end, 365))
    known = f.groupBy("firm").agg(F.min("day").alias("since"))
    c = panel.select("entity", "year").join(links.where("firm is not null"), "entity").withColumn("far", ~near)
    c = c.join(reports, ["firm", "year"], "left").join(known, "firm", "left")
    rank = F.struct(F.col("filed").isNull().alias("a"), F.col("since").isNull().alias("b"), "far", "place", "firm")
    chosen = c.groupBy("entity", "year").agg(F.min_by(F.struct("firm", "filed", "since"), rank).alias("c")).select("entity", "year", "c.*")
    found = chosen.where("filed is not null")
    form = F.col("form")
    windows = {
        "late_notice": (0, 120, form.startswith("NT 10-K")),
        "notices_3y": (0, 1095, form.startswith("NT 10")),
        "annual_amended_3y": (0, 1095, form.isin(*ANNUAL_AMENDED)),
        "quarterly_amended_3y": (0, 1095, form.isin(*QUARTERLY_AMENDED)),
        "current_1y": (0, 365, form.startswith("8-K")),
        "filings_1y": (0, 365, F.lit(True)),
    }
    x = T.past_counts(found, f, "firm", "filed", "day", {k: w[:2] for k, w in windows.items()}, {k: w[2] for k, w in windows.items()})
    x = x.join(percentiles(annual, "doy", [0.5], ["firm"], ["median"]), "firm").withColumns(
        {
            "doy": shifted_day(F.col("filed")).cast("double"),
            "late_notice": F.least("late_notice", F.lit(1)),
            "firm_age": F.datediff("filed", "since") / 365.25,
            "not_found": F.lit(0),
        }
    )
    x = x.withColumn("lag_vs_median", F.col("doy") - F.col("median"))
    names = ["entity", "year", "firm", "doy", "lag_vs_median", *windows, "firm_age", "not_found"]
    missing = chosen.where("filed is null").select("entity", "year", "firm", F.lit(1).alias("not_found"))
    return x.select(*names).unionByName(missing, allowMissingColumns=True).select(*names)


def audit_history(panel: DataFrame, audits: DataFrame, reports: DataFrame) -> DataFrame:
    """id and the measures of the auditor of each filing in panel (id, firm, t).

    audits: firm, period_end, auditor, partner, participants, share, signed (a day), form (a number, which settles ties); reports: auditor, day, rate,
    reviewed, clients, annual. The audit is the firm's last one whose period ended within the 400 days up to t; the one before it ended more
    than 300 days earlier. From these: auditor_changed and partner_changed (null without an earlier audit; null and anything else
    differ), participants and participant_share (0 where none is told), report_lag in days, auditor_audits (of the calendar year before
    the period's). From the auditor's last report before t: rate, rate_before and trend (null without an earlier report), reviewed,
    clients, annual, years_since; never is 1 where there is none yet, and null as all else without an audit. Audits without firm or
    period_end and reports without auditor, day or rate are left out.

    A report holds until the next one, so filings meet reports by auditor and span of days: an auditor of a third of all filings is joined in
    as many tasks as AQE makes of it, and not sorted in one.
    """
    a = audits.dropna(subset=["firm", "period_end"]).select("firm", F.col("period_end").cast("date").alias("end"), "auditor", "partner", "participants", "share", F.col("signed").cast("date").alias("signed"), "form")
    x = panel.select("id", F.col("firm").alias("_firm"), F.col("t").cast("date").alias("t"))
    values = ["end", "auditor", "partner", "participants", "share", "signed"]
    x = T.asof_backward(x, a.withColumnRenamed("firm", "_firm"), "_firm", "t", "end", values, strict=False, tolerance=400, order="form").drop("_day")
    before = a.select(F.col("firm").alias("_firm"), "end", "form", F.col("auditor").alias("_auditor"), F.col("partner").alias("_partner"))
    x = T.asof_backward(x.withColumn("_t", F.date_sub("end", 300)), before, "_firm", "_t", "end", ["_auditor", "_partner"], order="form")
    size = a.groupBy(F.col("auditor").alias("_a"), (F.year("end") + 1).alias("_y")).agg(F.count("*").alias("_audits"))
    x = x.join(size, (F.col("auditor") == F.col("_a")) & (F.year("end") == F.col("_y")), "left")
    r = reports.dropna(subset=["auditor", "day", "rate"])
    w = Window.partitionBy("auditor").orderBy("day", "rate", "reviewed", "clients", "annual")
    r = r.select(F.col("auditor").alias("_by"), F.col("day").cast("date").alias("_from"), F.lead(F.col("day").cast("date")).over(w).alias("_to"), "rate", F.lag("rate").over(w).alias("rate_before"), "reviewed", "clients", "annual")
    x = x.join(r, (F.col("auditor") == F.col("_by")) & (F.col("t") > F.col("_from")) & (F.col("_to").isNull() | (F.col("t") <= F.col("_to"))), "left")
    had, told = F.col("_day").isNotNull() & F.col("end").isNotNull(), F.col("end").isNotNull()
    differs = lambda c: F.when(had, (~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("long"))
    or0 = lambda c: F.when(told, F.coalesce(F.col(c), F.lit(0)))
    out = {
        "rate": F.col("rate"), "rate_before": F.col("rate_before"), "trend": F.col("rate") - F.col("rate_before"), "reviewed": F.col("reviewed"), "clients": F.col("clients"), "annual": F.col("annual"),
        "years_since": F.datediff("t", "_from") / 365.25, "never": F.when(F.col("auditor").isNotNull(), F.col("_from").isNull().cast("long")), "auditor_changed": differs("auditor"), "partner_changed": differs("partner"),
        "participants": or0("participants"), "participant_share": or0("share"), "report_lag": F.datediff("signed", "end").cast("long"), "auditor_audits": or0("_audits"),
    }
    return x.select("id", *[c.alias(k) for k, c in out.items()])


def change_of(now: str, before: str) -> Column:
    """The change over the size of the earlier value, which counts as 1 at least."""
    return (F.col(now) - F.col(before)) / F.greatest(F.lit(1.0), F.abs(F.col(before)))


def contradictions(df: DataFrame, key: str, year: str, least: int = 11) -> DataFrame:
    """key, tone and thirteen measures of words against numbers; all null where a row has no tone.

    df holds, a row per key (a number): year; tone, strong, growth_claim, adjusted (words); income, prior_income, revenue, prior_revenue, roa,
    loss, negative_equity, cash_ratio, late_days (numbers); not_effective, adverse, weaknesses, going_concern, corrections, notices_2y,
    letters_1y (disclosures). A product is null if either factor is; a comparison with a null is false, as a number that was never told is
    no evidence. Tone and roa are ranked from 0 to 1 within the year among the rows that have both, ties by key, in years of `least` such rows
    or more; tone is high above the year's median. df is read several times: write it first where it costs much.
    """
    both = F.col("tone").isNotNull() & F.col("roa").isNotNull()
    x = df.withColumns({"_t": F.when(both, F.col("tone")), "_r": F.when(both, F.col("roa"))})
    for of, name in (("_t", "_tone"), ("_r", "_roa")):
        x = ranks.placed(x, [year], of, key)
        x = x.withColumn(name, F.when(F.col("_n") >= least, F.try_divide("_i", F.col("_n") - 1))).drop("_i", "_n")
    x = ranks.matched(x, percentiles(df, "tone", [0.5], [year], ["_median"]), [year])
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    num = lambda c: F.col(c).cast("double")
    effective, quiet = 1 - num("not_effective"), 1 - num("going_concern")
    out = {
        "tone": num("tone"),
        "upbeat_while_income_fell": (F.col("tone") > F.col("_median")).cast("double") * yes(change_of("income", "prior_income") < -0.10),
        "strong_words_while_loss": num("strong") * num("loss"),
        "growth_claim_revenue_fell": num("growth_claim") * yes(change_of("revenue", "prior_revenue") < -0.05),
        "adjusted_over_loss": num("adjusted") * num("loss"),
        "tone_minus_roa_rank": F.col("_tone") - F.col("_roa"),
        "effective_but_adverse": effective * num("adverse"),
        "effective_but_weakness": effective * yes(num("weaknesses") > 0),
        "effective_but_corrected": effective * yes(num("corrections") > 0),
        "effective_but_late": effective * yes(num("late_days") > 0),
        "effective_but_notice": effective * yes(num("notices_2y") > 0),
        "effective_but_letters": effective * yes(num("letters_1y") > 0),
        "quiet_but_distressed": quiet * yes((num("negative_equity") > 0) & (num("loss") > 0) & (num("cash_ratio") < 0.05)),
        "doubt_but_profitable": num("going_concern") * yes((num("loss") == 0) & (num("negative_equity") == 0)),
    }
    told = F.col("tone").isNotNull()
    return x.select(F.col(key), *[F.when(told, c).alias(k) for k, c in out.items()])
