"""Ranks within groups of any size.

Values are counted before anything is ordered, and ranges of the value are ordered by themselves, each starting where the ranges below it
end. A value that many rows share is cut further by ranges of the column that settles ties. So no task sees all rows of a group, or of a
value. Operators here add columns and use names that begin with an underscore on the way.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rows a range should have, and the most and fewest ranges.
ROWS_PER_RANGE, MOST_RANGES, FEWEST_RANGES = 100_000, 4096, 8
_LOT = 64


def _doubles(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{x!r}D" for x in values) + ")")


def _place(v: Column, cuts: list[float]) -> Column:
    """How many cuts are smaller than a value; many cuts are searched by lots first."""
    if not cuts:
        return F.lit(0)
    if len(cuts) <= _LOT:
        return F.size(F.filter(_doubles(cuts), lambda c: c < v))
    lot = F.size(F.filter(_doubles(cuts[_LOT - 1 :: _LOT]), lambda c: c < v)) * _LOT
    return lot + F.size(F.filter(F.slice(_doubles(cuts), lot + 1, _LOT), lambda c: c < v))


def ranges(df: DataFrame, *columns: str, most: int = MOST_RANGES) -> list[Column]:
    """For each column of numbers, the range of a row among about equally filled ones, a range per ROWS_PER_RANGE rows and `most` at most.

    One pass counts the rows and finds the cuts of all columns; groups share them. Nulls are in the first range, NaN in the last.
    """
    shares = ", ".join(f"{i / MOST_RANGES!r}D" for i in range(1, MOST_RANGES))
    v = [F.col(c).cast("double") for c in columns]
    x = df.select(*[F.when(~F.isnan(c), c).alias(f"_{i}") for i, c in enumerate(v)])
    row = x.agg(F.count("*").alias("n"), *[F.expr(f"percentile_approx(_{i}, array({shares}), {8 * MOST_RANGES})").alias(f"_{i}") for i in range(len(v))]).first()
    k = min(most, max(FEWEST_RANGES, row["n"] // ROWS_PER_RANGE))
    at = [round(j * MOST_RANGES / k) - 1 for j in range(1, k)]
    finite = lambda c: c == c and abs(c) != float("inf")
    return [_place(c, sorted({q[j] for j in at if finite(q[j])}) if (q := row[f"_{i}"]) else []) for i, c in enumerate(v)]


def matched(df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join by columns of the same names, nulls being equal to nulls; df's are kept."""
    renamed = other.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    cond = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return df.join(renamed, cond, how).drop(*[f"_on{i}" for i in range(len(on))])


def below(g: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """g (few rows for each group, range _b and order) with, for each name in sums, the sum of the column over all rows before it in its
    group, and for each name in totals the sum over the group.

    Sums of whole ranges are few: a row per group and range.
    """
    totals = totals or {}
    per = g.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{k}") for k, c in (sums | totals).items()])
    up = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*by, "_b", *[F.coalesce(F.sum(f"_{k}").over(up), F.lit(0.0)).alias(f"_0{k}") for k in sums], *[F.sum(f"_{k}").over(Window.partitionBy(*by)).alias(k) for k in totals])
    run = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    g = matched(g, start, [*by, "_b"], "inner")
    g = g.withColumns({k: F.col(f"_0{k}") + F.coalesce(F.sum(c).over(run), F.lit(0.0)) for k, c in sums.items()})
    return g.drop(*[f"_0{k}" for k in sums])


def with_smaller(df: DataFrame, by: list[str], value: str, weight: Column, range_: Column, names: tuple[str, str, str]) -> DataFrame:
    """df with three columns: the weight of the group's rows with a smaller value, with the same value, and of all with a value. Null without a value."""
    smaller, same, all_ = names
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).cast("double").alias(same)).withColumn("_b", range_)
    g = below(g, by, [value], {smaller: F.col(same)}, {all_: F.col(same)}).drop("_b")
    out = matched(df, g, [*by, value])
    return out


def with_rank_pct(df: DataFrame, by: list[str], value: str, name: str = "pct") -> DataFrame:
    """df with the percentile rank within its group: the average rank of ties over the number of values. Rows without a value have none."""
    df = with_smaller(df, by, value, F.lit(1), ranges(df, value)[0], ("_under", "_same", "_all"))
    return df.withColumn(name, (F.col("_under") + (F.col("_same") + 1) / 2) / F.col("_all")).drop("_under", "_same", "_all")


def placed(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """df with _i, how many rows of the group come before it by value and then tie, and _n, the group's rows with a value; both null without one.

    Both columns hold numbers. Rows alike in both come in any order; rows of one value that also share one tie are ordered in one task.
    """
    by_value, by_tie = ranges(df, value, tie)
    df = df.withColumns({"_b": by_value, "_c": by_tie})
    piece = df.where(F.col(value).isNotNull()).groupBy(*by, value, "_b", "_c").agg(F.count("*").cast("double").alias("_m"))
    piece = below(piece, by, [value, "_c"], {"_i": F.col("_m")}, {"_n": F.col("_m")})
    df = matched(df.drop("_b"), piece.drop("_b", "_m"), [*by, value, "_c"])
    within = F.row_number().over(Window.partitionBy(*by, value, "_c").orderBy(tie)) - 1
    return df.withColumn("_i", F.col("_i") + within).drop("_c")


def with_rank_unit(df: DataFrame, by: list[str], value: str, tie: str, name: str = "unit") -> DataFrame:
    """df with the rank from 0 to 1 within its group; ties by another column; null in a group of one and without a value."""
    return placed(df, by, value, tie).withColumn(name, F.try_divide("_i", F.col("_n") - 1)).drop("_i", "_n")


def with_quantile(df: DataFrame, by: list[str], value: str, tie: str, k: int, name: str = "quantile") -> DataFrame:
    """df with the quantile 1 to k within its group, as cutting its first-come ranks at the k-quantiles gives it; null without a value."""
    cut = F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide(F.col("_i") * k, F.col("_n") - 1), F.lit(0.0))))
    return placed(df, by, value, tie).withColumn(name, F.when(F.col("_i").isNotNull(), cut)).drop("_i", "_n")
