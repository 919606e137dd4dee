"""Portfolio series from a long panel of entity, period and last price."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import quantile_cut


def panel(prices: DataFrame, entity: str, period: Column, value: str, order: list[str], most: float, low: float, high: float, dark: int, loss: float, next_period: int = 1) -> DataFrame:
    """entity, p, close, ret, nxt: the last price of each period, the return since the row before and that of the next row.

    Entities with any return above `most` or a price outside low .. high are left out whole; a price after one of zero is a return
    without bound, and leaves its entity out as well. If an entity's prices end more than `dark` periods before the panel does, its
    last return is worsened by `loss`, as its holders could not sell.
    """
    p = prices.groupBy(entity, period.alias("p")).agg(F.max_by(value, F.struct(*order)).alias("close"))
    w = Window.partitionBy(entity).orderBy("p")
    p = p.withColumn("_was", F.lag("close").over(w)).withColumn("ret", F.try_divide("close", "_was") - 1)
    own = Window.partitionBy(entity)
    bad = F.coalesce(F.max("ret").over(own) > most, F.lit(False)) | F.coalesce(F.bool_or(F.col("_was") == 0).over(own), F.lit(False)) | (F.max("close").over(own) > high) | (F.min("close").over(own) < low)
    p = p.withColumns({"_bad": bad, "_last": F.max("p").over(own)}).where("not _bad")
    end = F.broadcast(prices.agg(F.max(period).alias("_end")))
    p = p.crossJoin(end)
    gone = (F.col("p") == F.col("_last")) & (F.datediff("_end", "_last") > dark)
    p = p.withColumn("ret", F.when(gone, (1 + F.col("ret")) * (1 - loss) - 1).otherwise(F.col("ret")))
    nxt = F.when(F.lead("p").over(w) == F.date_add("p", next_period), F.lead("ret").over(w))
    return p.withColumn("nxt", F.coalesce(nxt, F.lit(0.0))).select(entity, "p", "close", "ret", "nxt")


def legs(df: DataFrame, entity: str, signal: str, k: int, least: int) -> DataFrame:
    """p, n, high, low, spread, rest: mean next returns of the top and bottom quantile by the signal, of all but the top one.

    Periods with fewer than `least` entities are left out.
    """
    df = df.withColumns({"q": quantile_cut(["p"], signal, entity, k), "_n": F.count("*").over(Window.partitionBy("p"))}).where(F.col("_n") >= least)
    mean = lambda c: F.avg(F.when(c, F.col("nxt")))
    g = df.groupBy("p").agg(F.count("*").alias("n"), mean(F.col("q") == k).alias("high"), mean(F.col("q") == 1).alias("low"), mean(F.col("q") < k).alias("rest"))
    return g.withColumn("spread", F.col("high") - F.col("low"))


def net(df: DataFrame, gross: str, turnover: str, cost: float, borrow: float, per_year: int) -> Column:
    """Gross less cost on what is traded and the fee for what is borrowed."""
    return F.col(gross) - cost * F.col(turnover) - borrow / per_year
