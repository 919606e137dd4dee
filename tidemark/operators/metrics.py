"""Ranking metrics and resampling.

Tied scores are counted before anything is ordered, and a ranking is made in ranges of the score, by group or over all rows: each range
is ordered by itself and starts where the ranges below it end, so no task sees all rows of a group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import below, ranges

def ranked_counts(df: DataFrame, score: str, y: str, by: list[str] | None = None, weight: Column | None = None, range_: Column | None = None) -> DataFrame:
    """range_: the range of a score, where the caller knows it from fewer rows than df has.

    by, score, pos, neg, below, below_neg: weights of positives and negatives of each distinct score, of all rows and of negatives with smaller scores."""
    by, w = by or [], weight if weight is not None else F.lit(1.0)
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    g = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg"))
    g = g.withColumn("_b", ranges(df, score)[0] if range_ is None else range_)
    return below(g, by, [score], {"below": F.col("pos") + F.col("neg"), "below_neg": F.col("neg")}).drop("_b")


def percentiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """by and a column per share: exact percentiles with linear interpolation, over ranges of the value, so that no task holds a group.

    Values are counted first; the two values around each share lie in known ranges, and only those ranges are ordered.
    """
    by, names = by or [], names or [f"q{i}" for i in range(len(at))]
    df = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    g = df.groupBy(*by, "_v").agg(F.count("*").cast("double").alias("_n")).withColumn("_b", ranges(df, "_v")[0])
    g = below(g, by, ["_v"], {"_from": F.col("_n")}, {"_all": F.col("_n")})
    # Row numbers from 0: a share lies between the whole places around it.
    place = {n: F.lit(q) * (F.col("_all") - 1) for n, q in zip(names, at, strict=True)}
    held = lambda k: (F.col("_from") <= k) & (k < F.col("_from") + F.col("_n"))
    picks = [F.max(F.when(held(f(p)), F.col("_v"))).alias(f"_{n}{i}") for n, p in place.items() for i, f in enumerate((F.floor, F.ceil))]
    out = g.groupBy(*by).agg(F.max("_all").alias("_all"), *picks)
    mixed = [(F.col(f"_{n}0") + (F.col(f"_{n}1") - F.col(f"_{n}0")) * (p - F.floor(p))).alias(n) for n, p in place.items()]
    return out.select(*by, *mixed)


def auc(df: DataFrame, score: str, y: str, by: list[str] | None = None, weight: Column | None = None, range_: Column | None = None) -> DataFrame:
    """by, n, pos, auc: the chance that a positive scores above a negative, ties half. Null where a class is missing."""
    by = by or []
    c = ranked_counts(df, score, y, by, weight, range_)
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return c.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("pos"), F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_without(df: DataFrame, score: str, y: str, group: str) -> DataFrame:
    """left_out, n, pos, auc: the metric over all rows but those of one group (say a year), for each group in turn.

    Rows are counted per group and score first; these counts are repeated per group left out, the rows are not. Groups are few. Rows of
    a null group are in no group and stay in all.
    """
    c = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(score).alias("_s"), (F.col(y) == 1).cast("int").alias("_y")).agg(F.count("*").cast("double").alias("_w"))
    groups = F.broadcast(df.agg(F.collect_set(group).alias("_all")))
    c = c.crossJoin(groups).withColumn("left_out", F.explode(F.filter("_all", lambda g: ~g.eqNullSafe(F.col("_g")))))
    return auc(c, "_s", "_y", ["left_out"], F.col("_w"))


def auc_of_new(train: DataFrame, test: DataFrame, score: str, y: str, entity: str) -> DataFrame:
    """subset, n, pos, auc: the metric over all test rows (all), those of entities without a positive in training (no_positive) and those
    of entities that training has never seen (new). What is lost from one to the next was known from the entity. Null entities are new."""
    seen = train.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max((F.coalesce(F.col(y), F.lit(0)) == 1).cast("int")).alias("_hit"))
    x = test.join(seen, entity, "left")
    subsets = F.array(F.lit("all"), F.when(F.coalesce(F.col("_hit"), F.lit(0)) == 0, "no_positive"), F.when(F.col("_hit").isNull(), "new"))
    return auc(x.select(score, y, F.explode(F.array_compact(subsets)).alias("subset")), score, y, ["subset"])


def auc_per_feature(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """feature, coverage, auc: each feature by itself over the rows that have it."""
    long = df.select(y, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([y], features, "feature", "v")
    cover = long.groupBy("feature").agg((F.count("v") / F.count(F.lit(1))).alias("coverage"))
    return auc(long, "v", y, ["feature"]).join(F.broadcast(cover), "feature").select("feature", "coverage", "auc")


def precision_at(df: DataFrame, score: str, y: str, tie: str, k: int) -> DataFrame:
    """k, hits, precision, lift over the base rate, of the k highest scores (ties by the tie column, ascending)."""
    top = df.orderBy(F.desc(score), F.asc(tie)).limit(k).agg(F.sum(y).alias("hits"), F.count("*").alias("k"))
    base = df.agg(F.avg(y).alias("base"))
    return top.crossJoin(F.broadcast(base)).select(F.col("k").cast("long").alias("k"), F.col("hits").cast("long").alias("hits"), (F.col("hits") / F.col("k")).alias("precision"), F.try_divide(F.col("hits") / F.col("k"), "base").alias("lift"))


def ndcg(df: DataFrame, score: str, y: str, tie: str, fraction: float) -> DataFrame:
    """k, ndcg of the top fraction; the ideal order has all positives first. Only the scores' range in which the fraction ends, and those above
    it, are ordered, each by itself."""
    total = df.agg(F.count("*").alias("n"), F.sum(y).alias("p")).first()
    k = max(1, int((total["n"] or 0) * fraction))
    ranged = df.select(score, y, tie).withColumn("_b", ranges(df, score)[0])
    per = ranged.groupBy("_b").agg(F.count("*").alias("_c"))
    up = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    start = F.broadcast(per.select("_b", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_0")).where(F.col("_0") < k))
    place = F.col("_0") + F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(score), F.asc(tie)))
    top = ranged.join(start, "_b").withColumn("i", place).where(F.col("i") <= k)
    ideal = df.sparkSession.range(1, min(k, int(total["p"] or 0)) + 1).agg(F.sum(1 / F.log2(F.col("id") + 1)).alias("ideal"))
    return top.agg(F.sum(F.col(y) / F.log2(F.col("i") + 1)).alias("dcg")).crossJoin(F.broadcast(ideal)).select(F.lit(k).cast("long").alias("k"), F.try_divide("dcg", "ideal").alias("ndcg"))


def _poisson_edges(n: int = 12) -> list[float]:
    """The distribution function of Poisson(1) at 0 .. n-1."""
    out, p, total = [], 2.718281828459045**-1, 0.0
    for i in range(n):
        total += p
        out.append(total)
        p /= i + 1
    return out


POISSON_EDGES = _poisson_edges()


def poisson_weight(key: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a row is drawn in a bootstrap replicate: Poisson(1), from the md5 of seed, key and replicate, so reruns and engines agree."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), replicate.cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))
    # Within an array of one, so that the hash is computed once and not for each edge.
    return F.transform(F.array(u), lambda v: sum((F.when(v >= e, 1.0).otherwise(0.0) for e in POISSON_EDGES), F.lit(0.0)))[0]


def bootstrap_auc(df: DataFrame, scores: list[str], y: str, unit: str, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, and the AUC of each score with rows weighted as drawn. unit: the key that is drawn (a row's, or an entity's).

    All scores share the draws, so their differences are paired. Replicates without both classes are null.
    """
    drawn = df.select(unit, y, *scores).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("w", poisson_weight(F.col(unit), F.col("replicate"), seed)).where("w > 0")
    long = drawn.unpivot(["replicate", y, "w"], scores, "model", "s")
    # Ranges come from the rows as they are, not from their replicates; few of them do, as each replicate is ordered by itself.
    once = df.select(*[F.col(s).cast("double").alias(s) for s in scores]).unpivot([], scores, "model", "s").where("s is not null")
    each = auc(long, "s", y, ["replicate", "model"], F.col("w"), ranges(once, "s", most=8)[0])
    return each.groupBy("replicate").agg(*[F.max(F.when(F.col("model") == s, F.col("auc"))).alias(s) for s in scores])


def interval(values: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """lo, hi, and the share of replicates at or below zero."""
    a = (1 - level) / 2
    return values.agg(F.percentile(value, F.lit(a)).alias("lo"), F.percentile(value, F.lit(1 - a)).alias("hi"), F.avg((F.col(value) <= 0).cast("int")).alias("p_le_0"))
