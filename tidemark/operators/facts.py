"""Long facts to wide panels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_pick(facts: DataFrame, keys: list[str], rank: str, line: str, value: str) -> DataFrame:
    """One value per key: that of the smallest rank, of equal ranks the first line. A struct minimum, so partial results merge."""
    return facts.groupBy(*keys).agg(F.min_by(value, F.struct(rank, line, value)).alias(value))


def pivot_wide(facts: DataFrame, keys: list[str], name: str, value: str, names: list[str], agg=F.sum) -> DataFrame:
    """A row per key with a column per name. The names are given, so no pass over the data looks for them."""
    return facts.groupBy(*keys).agg(*[agg(F.when(F.col(name) == x, F.col(value))).alias(x) for x in names])


def with_prior(panel: DataFrame, key: str, period: str, columns: list[str], prefix: str = "p_") -> DataFrame:
    """Rows whose key has a row for the period before, with that row's columns under a prefix."""
    prior = panel.select(key, (F.col(period) + 1).alias(period), *[F.col(c).alias(prefix + c) for c in columns])
    return panel.join(prior, [key, period])


def leading_digit(v: Column) -> Column:
    return F.substring(F.floor(F.abs(v)).cast("long").cast("string"), 1, 1).cast("int")


#: Benford's law.
BENFORD = [0.30103, 0.176091, 0.124939, 0.09691, 0.0791812, 0.0669468, 0.0579919, 0.0511525, 0.0457575]


def benford(df: DataFrame, keys: list[str], value: str, least: float = 10.0, enough: int = 20) -> DataFrame:
    """key, n, mad, chi2 of the leading digits of values of at least `least` in size; null measures below `enough` values."""
    d = df.where(F.abs(value) >= least).withColumn("_d", leading_digit(F.col(value)))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("_d") == i + 1, 1)).alias(f"d{i}") for i in range(9)])
    gaps = [F.col(f"d{i}") / F.col("n") - b for i, b in enumerate(BENFORD)]
    mad = sum((F.abs(x) for x in gaps), F.lit(0.0)) / 9
    chi2 = F.col("n") * sum((x * x / b for x, b in zip(gaps, BENFORD, strict=True)), F.lit(0.0))
    ok = F.col("n") >= enough
    return g.select(*keys, F.col("n").cast("long").alias("n"), F.when(ok, mad).alias("mad"), F.when(ok, chi2).alias("chi2"))


def determinants(filings: DataFrame, values: DataFrame, dimensions: DataFrame, history: DataFrame, segment: str, geography: str, rate: float = 0.21) -> DataFrame:
    """id and eleven determinants of each filing in filings (id, firm, filed).

    values: a row per id with assets, restructuring, deferred, pretax, foreign, current_tax, allowance and prior_allowance; dimensions: id, parts
    (of the form axis=member, joined by ;), several rows per id; history: firm, day. firm_age: years since the firm's first day; n_segments and
    n_geographies: distinct parts that begin with the axis; shares of assets: restructuring (0 where none is told), deferred, the gap of
    pretax income to the one that the tax at `rate` implies, the change of the allowance; foreign_share of pretax income, from -2 to 2; flags of
    foreign income, restructuring and allowance. All but the first three are null without assets above zero.
    """
    part = dimensions.select("id", F.explode(F.split("parts", ";")).alias("part"))
    n_of = lambda axis: F.count_distinct(F.when(F.col("part").startswith(axis), F.col("part")))
    counts = part.groupBy("id").agg(n_of(segment).alias("n_segments"), n_of(geography).alias("n_geographies"))
    x = filings.select("id", "firm", "filed").join(values, "id", "left").join(counts, "id", "left").join(history.groupBy("firm").agg(F.min("day").alias("_first")), "firm", "left")
    big, some = F.col("assets") > 0, lambda c: (F.coalesce(F.col(c), F.lit(0)) != 0).cast("long")
    over = lambda c: F.when(big, F.try_divide(c, F.col("assets")))
    return x.select(
        "id", (F.datediff("filed", "_first") / 365.25).alias("firm_age"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_geographies", F.lit(0)).alias("n_geographies"),
        over(F.coalesce("restructuring", F.lit(0.0))).alias("restructuring"), over(F.col("deferred")).alias("deferred"),
        F.when(big, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.try_divide("foreign", F.abs("pretax")))) * F.when(F.col("foreign").isNotNull() & (F.col("pretax") != 0), 1.0)).alias("foreign_share"),
        over(F.col("pretax") - F.col("current_tax") / rate).alias("tax_gap"), over(F.col("allowance") - F.col("prior_allowance")).alias("allowance_change"),
        *[F.when(big, some(c)).alias(f"has_{c}") for c in ("foreign", "restructuring", "allowance")],
    )
