"""Calibration by group, and weights for rows whose labels are not there yet or may be wrong."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group is cut into; each level of merging joins this many.
RANGES, FAN = 64, 8


def _pooled(pdf):
    """Adjacent blocks (low, high, n, p) merged while their rates fall: pool adjacent violators. Pooling pooled parts gives what pooling all at once gives."""
    import pandas as pd

    pdf = pdf.sort_values("low")
    out: list[list] = []
    for low, high, n, p in zip(pdf["low"], pdf["high"], pdf["n"], pdf["p"], strict=True):
        out.append([low, high, n, p])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high_, n_, p_ = out.pop()
            out[-1][1:] = [high_, out[-1][2] + n_, out[-1][3] + p_]
    return pd.DataFrame(out, columns=["low", "high", "n", "p"]).assign(g=pdf["g"].iloc[0], r=pdf["r"].iloc[0])


def isotonic_blocks(df: DataFrame, g: str, score: str, y: str) -> DataFrame:
    """g, low, high, n, p: the rising steps of the rate of positives over the score, by group.

    Equal scores are summed first. A group is cut into ranges at its own quantiles; each range is pooled by itself, then neighbouring ranges are, level by
    level, so that a task has a range of rows or the steps of a few ranges, and never a group's rows. Rows without score or label are left out.
    """
    sums = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(g).alias("g"), F.col(score).cast("double").alias("low")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    cuts = sums.groupBy("g").agg(F.percentile_approx("low", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts")).withColumnRenamed("g", "_g")
    at = sums.join(cuts, F.col("g").eqNullSafe(F.col("_g"))).select("g", "low", F.col("low").alias("high"), "n", "p", F.size(F.filter("cuts", lambda c: c < F.col("low"))).alias("r"))
    schema = at.select("low", "high", "n", "p", "g", "r").schema
    left = RANGES
    while True:
        at = at.groupBy("g", "r").applyInPandas(_pooled, schema)
        if left == 1:
            return at.drop("r")
        at, left = at.withColumn("r", F.call_function("div", F.col("r"), F.lit(FAN)).cast("int")), -(-left // FAN)


def calibrated(train: DataFrame, df: DataFrame, group: str, score: str, y: str, least_rows: int = 300, least_positives: int = 15, name: str = "calibrated") -> DataFrame:
    """df with the calibrated rate: by the steps of its group, or by those of all training rows where the group has fewer than
    least_rows rows or least_positives positives. Between two steps it is interpolated, beyond them it is the outer step's; null without a score."""
    support = train.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("long")).alias("_p"))
    own = support.where((F.col("_n") >= least_rows) & (F.col("_p") >= least_positives)).select("_group", F.lit(1).alias("_own"))
    key = F.when(F.col("_own") == 1, F.struct(F.col(group).cast("string").alias("v")))  # null: all rows

    def keyed(d: DataFrame) -> DataFrame:
        return d.join(own, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_key", F.to_json(key, {"ignoreNullFields": "false"})).drop("_group", "_own")

    mine = keyed(train).where("_key is not null").select("_key", score, y)
    blocks = isotonic_blocks(mine.unionByName(train.select(F.lit(None).cast("string").alias("_key"), score, y)), "_key", score, y)
    points = blocks.select(F.col("g").alias("_key"), F.explode(F.array("low", "high")).alias("_s"), (F.col("p") / F.col("n")).alias("_v")).distinct()
    # Neighbouring points of a row, over ranges of the score by group; a range takes the last point before it and the first after it from all others.
    cuts = points.groupBy("_key").agg(F.percentile_approx("_s", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")).withColumnRenamed("_key", "_k")

    def ranged(d: DataFrame) -> DataFrame:
        r = F.size(F.filter("_cuts", lambda c: c < F.col("_s")))
        return d.join(cuts, F.col("_key").eqNullSafe(F.col("_k"))).withColumn("_r", r).drop("_k", "_cuts")

    point = F.struct("_s", "_v")
    points = ranged(points)
    edge = points.groupBy("_key", "_r").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    spine = points.select("_key").distinct().withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1)))).join(edge.select(F.col("_key").alias("_k"), F.col("_r").alias("_q"), "_last", "_first"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q")), "left")
    w = Window.partitionBy("_key").orderBy("_r")
    spine = spine.select(F.col("_key").alias("_k"), F.col("_r").alias("_q"), F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    rows = ranged(keyed(df).withColumn("_s", F.col(score).cast("double")).where("_s is not null"))
    both = rows.withColumn("_point", F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)).unionByName(points.select("_key", "_s", "_r", point.alias("_point")), allowMissingColumns=True)
    at = Window.partitionBy("_key", "_r").orderBy("_s")
    # From the highest score down: a frame that looks ahead is gone through again for each row.
    back = Window.partitionBy("_key", "_r").orderBy(F.desc("_s")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_low": F.last("_point", True).over(at.rangeBetween(Window.unboundedPreceding, 0)), "_high": F.last("_point", True).over(back)})
    both = both.where("_point is null").join(spine, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q")), "left")
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    gap = high["_s"] - low["_s"]
    value = F.when(low.isNull(), high["_v"]).when(high.isNull() | (gap <= 0), low["_v"]).otherwise(low["_v"] + (high["_v"] - low["_v"]) * (F.col("_s") - low["_s"]) / gap)
    out = both.select(*df.columns, value.alias(name))
    return out.unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("double")))


def delay_curve(df: DataFrame, lag: str, seen: str) -> DataFrame:
    """lag, at_risk, events, matured: the share of events reported within lag days, by the product limit over censored lags.

    lag counts days to the report or, where seen is false, to the end of observation. Rows are summed by lag first, so the product runs over days.
    """
    by = df.where(F.col(lag) >= 0).groupBy(F.col(lag).alias("lag")).agg(F.count("*").alias("n"), F.sum(F.col(seen).cast("long")).alias("events"))
    w = Window.orderBy("lag")
    by = by.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("lag"))))
    left = 1 - F.col("events") / F.col("at_risk")
    none = F.max((left <= 0).cast("int")).over(w) == 1
    product = F.exp(F.sum(F.when(left > 0, F.log(left)).otherwise(0.0)).over(w))
    return by.select("lag", "at_risk", "events", F.when(none, 1.0).otherwise(1 - product).alias("matured"))


def maturity_weight(df: DataFrame, curve: DataFrame, elapsed: str, y: str, floor: float = 0.05, name: str = "weight") -> DataFrame:
    """df with a weight: 1 for positives; for the others the share of events that would be known after the days elapsed, at least floor.

    curve is that of delay_curve, a row a day, and is sent to the executors as one array.
    """
    steps = curve.agg(F.sort_array(F.collect_list(F.struct("lag", "matured"))).alias("_steps"))
    known = F.coalesce(F.array_max(F.filter("_steps", lambda s: s["lag"] <= F.col(elapsed)))["matured"], F.lit(0.0))
    return df.crossJoin(F.broadcast(steps)).withColumn(name, F.when(F.col(y) == 1, 1.0).otherwise(F.greatest(F.lit(floor), known))).drop("_steps")


def unlabelled_weight(df: DataFrame, score: str, y: str, held_out: Column, name: str = "weight") -> DataFrame:
    """df with prior (the estimated share of true positives) and a weight: the chance that the row is what its label says.

    Labels are positive or unknown. The mean held-out score of labelled positives is the rate at which positives are labelled at all, so the true
    share is the labelled share over that rate, and an unlabelled row of score s is positive by the odds (1 - rate) / rate * s / (1 - s).
    """
    one = df.agg(F.avg(F.when(held_out & (F.col(y) == 1), F.col(score))).alias("_rate"), F.avg(F.col(y).cast("double")).alias("_share"))
    s = F.least(F.col(score).cast("double"), F.lit(1 - 1e-9))
    positive = F.least(F.lit(1.0), F.try_divide((1 - F.col("_rate")) * s, F.col("_rate") * (1 - s)))
    prior = F.least(F.lit(1.0), F.try_divide("_share", "_rate")).alias("prior")
    return df.crossJoin(F.broadcast(one)).select(*df.columns, prior, F.when(F.col(y) == 1, 1.0).otherwise(1 - positive).alias(name))
