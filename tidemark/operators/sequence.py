"""Ranks, trailing statistics and smoothing per entity or group."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import matched, ranges, with_smaller


def rank_pct(value: str, by: list[str]) -> Column:
    """Percentile rank within a group that fits a task (others: `ranks.with_rank_pct`): the average rank of ties over the group's size."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return (F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2) / F.count("*").over(Window.partitionBy(*by))


def rank_unit(by: list[str], value: str, tie: str) -> Column:
    """Rank from 0 to 1 within a group that fits a task (others: `ranks.with_rank_unit`); ties by another column; null in a group of one."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))
    return F.try_divide(rn - 1, F.count("*").over(Window.partitionBy(*by)) - 1)


def quantile_cut(by: list[str], value: str, tie: str, k: int) -> Column:
    """The quantile 1 to k of a row within a group that fits a task (others: `ranks.with_quantile`), as cutting its first-come ranks at the k-quantiles gives it."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))
    return F.greatest(F.lit(1), F.ceil(F.try_divide((rn - 1) * k, F.count("*").over(Window.partitionBy(*by)) - 1)))


def trailing(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, least: int) -> DataFrame:
    """df with mean, sd (population) and slope (per row) of the previous `rows` rows, null with fewer than `least` values."""
    at = Window.partitionBy(*key).orderBy(*order)
    w = at.rowsBetween(-rows, -1)
    df = df.withColumn("_i", F.row_number().over(at).cast("double"))
    i = F.when(F.col(value).isNotNull(), F.col("_i"))
    vi = F.avg(F.col(value) * i).over(w) - F.avg(value).over(w) * F.avg(i).over(w)
    slope = F.try_divide(vi, F.avg(i * i).over(w) - F.avg(i).over(w) * F.avg(i).over(w))
    enough = F.count(value).over(w) >= least
    out = {"mean": F.avg(value).over(w), "sd": F.stddev_pop(value).over(w), "slope": slope}
    return df.withColumns({k: F.when(enough, v) for k, v in out.items()}).drop("_i")


def month_end(df: DataFrame, key: list[str], day: str, value: str, tie: str) -> DataFrame:
    """The last value of each month: key, month (its first day), last."""
    return df.groupBy(*key, F.trunc(day, "MM").alias("month")).agg(F.max_by(value, F.struct(day, tie)).alias("last"))


def decayed(value: str, key: list[str], order: list[str], weights: list[float]) -> Column:
    """Weighted average of a value and those before it, over the weights of those present."""
    w = Window.partitionBy(*key).orderBy(*order)
    past = [F.lag(value, i).over(w) if i else F.col(value) for i in range(len(weights))]
    top = sum((F.coalesce(p * x, F.lit(0.0)) for p, x in zip(past, weights, strict=True)), F.lit(0.0))
    return F.try_divide(top, sum((F.when(p.isNotNull(), x).otherwise(0.0) for p, x in zip(past, weights, strict=True)), F.lit(0.0)))


def smoothed(df: DataFrame, key: list[str], order: str, value: str, weight: float) -> DataFrame:
    """key, order, value, smooth: (value + weight * last smooth) / (1 + weight), the first as it is.

    The recursion unrolls to a sum over the past with powers of weight / (1 + weight), so it is a window and no loop. The frame
    goes back until a power is below the precision of a double, so it is bounded by the weight and not by the entity's rows.
    """
    at = Window.partitionBy(*key).orderBy(order)
    q = weight / (1 + weight)
    back = int(-40 / math.log(q)) + 1 if q > 0 else 1
    df = df.withColumn("_i", F.row_number().over(at) - 1)
    parts = F.collect_list(F.struct(F.col("_i").alias("i"), F.when(F.col("_i") == 0, F.col(value)).otherwise(F.col(value) / (1 + weight)).alias("x"))).over(at.rowsBetween(-back, 0))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * q + p["x"])
    return df.withColumn("smooth", total).drop("_i")


def train_percentile(df: DataFrame, group: list[str], fallback: list[str], value: str, train: str, least: int) -> DataFrame:
    """df with pct: the share of training values of the row's group that are smaller.

    A group without training values uses its fallback group; a pool of fewer than `least` gives null, and so does a row without a value.
    Values are counted per group and ordered by ranges, so no task holds a pool.
    """
    one = F.when(F.col(train), 1).otherwise(0)
    at = ranges(df, value)[0]
    df = with_smaller(df, group, value, one, at, ("_bg", "_sg", "_ng"))
    df = with_smaller(df, fallback, value, one, at, ("_bf", "_sf", "_nf"))
    own = F.when(F.col("_ng") >= least, F.col("_bg") / F.col("_ng"))
    pct = F.when(F.col(value).isNotNull(), F.when(F.col("_ng") > 0, own).when(F.col("_nf") >= least, F.col("_bf") / F.col("_nf")))
    return df.withColumn("pct", pct).drop("_bg", "_sg", "_ng", "_bf", "_sf", "_nf")


def previous_keys(df: DataFrame, by: str, key: str) -> DataFrame:
    """key, prev: the key before each one within a group, over ranges of the key, the edge of the last range that has any carried over."""
    df = df.select(by, key, ranges(df, key)[0].alias("bin"))
    last = df.groupBy(by, "bin").agg(F.max(key).alias("edge"))  # a row per group and range
    carried = last.select(by, "bin", F.lag("edge").over(Window.partitionBy(by).orderBy("bin")).alias("edge"))
    df = matched(df, carried, [by, "bin"], "inner")
    prev = F.coalesce(F.lag(key).over(Window.partitionBy(by, "bin").orderBy(key)), "edge")
    return df.select(key, prev.alias("prev")).where("prev is not null")
