"""Learners and their preparation. Statistics come from the training rows only; what reaches the driver is bounded by the columns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import percentiles


def impute_median(df: DataFrame, features: list[str], train: Column, plain: int = 0) -> DataFrame:
    """Nulls become the training median (0 for a column without values), and each feature but the last `plain` ones gets an indicator
    <name>_missing. Exact medians of all features at once, over ranges of their values, found while the query is planned; the plan holds them as numbers."""
    long = df.where(train).select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "v")
    q = percentiles(long, "v", [0.5], ["feature"], ["m"])
    # Looked up once, a row for each feature: what is fitted reads its rows many times over.
    medians = {r["feature"]: r["m"] for r in q.collect() if r["m"] is not None}
    flagged = features[: len(features) - plain]
    df = df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in flagged} | {f: F.coalesce(F.col(f).cast("double"), F.lit(medians.get(f, 0.0))) for f in features})
    return df


def standardise(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a constant column becomes zero."""
    stats = df.where(train).agg(*[F.avg(f).alias(f"_a_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    df = df.crossJoin(F.broadcast(stats))
    out = {f: F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_a_{f}")) / F.col(f"_s_{f}")).otherwise(F.when(F.col(f).isNotNull(), 0.0)) for f in features}
    return df.withColumns(out).drop(*[f"_{k}_{f}" for k in "as" for f in features])


def balanced_weight(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Each class has half of the weight."""
    c = df.agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(c)).withColumn(name, F.try_divide("_n", 2 * F.when(F.col(y) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))).drop("_p", "_n")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def _positive(model, df: DataFrame, features: list[str], name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_assembled(df, features))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def logistic(train: DataFrame, df: DataFrame, features: list[str], y: str, weight: str | None = None, name: str = "score") -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    lr = LogisticRegression(featuresCol="_x", labelCol=y, maxIter=50, regParam=1e-3, **({"weightCol": weight} if weight else {}))
    return _positive(lr.fit(_assembled(train, features)), df, features, name)


def boosted(train: DataFrame, df: DataFrame, features: list[str], y: str, trees: int = 10, depth: int = 3, name: str = "score") -> DataFrame:
    from pyspark.ml.classification import GBTClassifier

    return _positive(GBTClassifier(featuresCol="_x", labelCol=y, maxIter=trees, maxDepth=depth, seed=7).fit(_assembled(train, features)), df, features, name)


def balanced_forest(train: DataFrame, features: list[str], y: str, key: str, bags: int = 4, trees: int = 5, ratio: float = 1.0, leaf: int = 5):
    """A list of forests, each on all positives and about `ratio` negatives for each, drawn by a hash of key and bag.

    An approximation of one draw per tree: the negatives are drawn once for the few trees of a bag.
    """
    from pyspark.ml.classification import RandomForestClassifier

    c = train.agg(F.sum(y).alias("p"), F.count("*").alias("n")).first()
    share = min(1.0, ratio * (c["p"] or 0) / max(1, c["n"] - (c["p"] or 0)))
    out = []
    for bag in range(bags):
        drawn = F.pmod(F.xxhash64(F.lit(bag), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * share)
        rf = RandomForestClassifier(featuresCol="_x", labelCol=y, numTrees=trees, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", maxDepth=8, seed=bag)
        out.append(rf.fit(_assembled(train.where((F.col(y) == 1) | drawn), features)))
    return out


def forest_score(models: list, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """The mean of the bags' probabilities."""
    parts = [f"_{name}{i}" for i in range(len(models))]
    for m, p in zip(models, parts, strict=True):
        df = _positive(m, df, features, p)
    return df.withColumn(name, sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)).drop(*parts)


def importances(models: list, features: list[str]) -> list[tuple[str, float]]:
    total = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return sorted(zip(features, total, strict=True), key=lambda x: (-x[1], x[0]))


def tree_attribution(models: list, df: DataFrame, features: list[str]) -> DataFrame:
    """df with attr_<feature>: how much the splits on it move the score of a row from the root's mean to its leaf's, over all trees.

    The trees are small and are sent as arrays; rows go through them batch by batch.
    """
    trees = []
    for m in models:
        for tree in m.trees:
            nodes: list = []

            def walk(node, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append(None)
                stats = list(node.impurityStats().stats()) if hasattr(node, "impurityStats") else [1.0, 0.0]
                value = stats[1] / (stats[0] + stats[1]) if stats[0] + stats[1] else 0.0
                if node.subtreeDepth() == 0:
                    nodes[at] = (-1, 0.0, 0, 0, value)
                else:
                    split = node.split()
                    nodes[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), value)
                return at

            walk(tree._call_java("rootNode"))
            trees.append(nodes)

    names = [f"attr_{f}" for f in features]

    def run(batches):
        import numpy as np

        for pdf in batches:
            x = pdf[features].to_numpy(float)
            out = np.zeros((len(pdf), len(features)))
            for nodes in trees:
                at = np.zeros(len(pdf), int)
                table = np.array([(n[0], n[1], n[2], n[3], n[4]) for n in nodes])
                while True:
                    f = table[at, 0].astype(int)
                    live = np.nonzero(f >= 0)[0]
                    if not len(live):
                        break
                    go = np.where(x[live, f[live]] <= table[at[live], 1], table[at[live], 2], table[at[live], 3]).astype(int)
                    np.add.at(out, (live, f[live]), table[go, 4] - table[at[live], 4])
                    at[live] = go
            for i, name in enumerate(names):
                pdf[name] = out[:, i] / len(trees)
            yield pdf

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return df.mapInPandas(run, schema)


def fold_of(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(k))


def out_of_fold(df: DataFrame, features: list[str], y: str, group: str, k: int, name: str = "score") -> DataFrame:
    """Each row scored by a model that has seen no row of its group."""
    df = df.withColumn("_fold", fold_of(F.col(group), k))
    parts = [logistic(df.where(F.col("_fold") != i), df.where(F.col("_fold") == i), features, y, name=name) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


def isotonic(train: DataFrame, df: DataFrame, score: str, y: str, name: str = "calibrated") -> DataFrame:
    """df with the rate of positives at its score, a rising step line through the training rows; beyond their range its ends."""
    from pyspark.ml.regression import IsotonicRegression

    vec = lambda d: _assembled(d, [score])
    m = IsotonicRegression(featuresCol="_x", labelCol=y, predictionCol=name).fit(vec(train.select(score, F.col(y).cast("double").alias(y))))
    return m.transform(vec(df)).drop("_x")


def ols(df: DataFrame, y: str, xs: list[str], order: list[str] | None = None, lags: int = 0):
    """Coefficients, and Newey-West errors with `lags` if an order is given (else plain ones), from sums made in Spark.

    What is gathered is a (k + 1)-square matrix. Rows with nulls are left out. The order is that of a time series, of one row
    per period.
    """
    import numpy as np

    names = ["_one", *xs]
    df = df.select(*(order or []), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna().withColumn("_one", F.lit(1.0))
    k = len(names)
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("_y")) for a in names] + [F.count("*")]
    got = list(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    xx = np.zeros((k, k))
    upper = iter(got[: k * (k + 1) // 2])
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = next(upper)
    beta = np.linalg.solve(xx, np.array(got[k * (k + 1) // 2 : -1]))
    n = got[-1]
    res = F.col("_y") - sum((F.col(a) * float(b) for a, b in zip(names, beta, strict=True)), F.lit(0.0))
    df = df.withColumn("_u", res)
    inv = np.linalg.inv(xx)
    if order is None:
        s2 = df.agg(F.sum(F.col("_u") * F.col("_u"))).first()[0] / max(1, n - k)
        return names, beta, np.sqrt(np.diag(inv) * s2)
    w = Window.orderBy(*order)
    past = df.select(*[(F.col(a) * F.col("_u")).alias(f"g{i}") for i, a in enumerate(names)], *order)
    past = past.select(*[F.col(f"g{i}") for i in range(k)], *[F.lag(f"g{i}", lag).over(w).alias(f"g{i}_{lag}") for lag in range(1, lags + 1) for i in range(k)])
    terms = [F.sum(F.col(f"g{i}") * F.col(f"g{j}" if not lag else f"g{j}_{lag}")) for lag in range(lags + 1) for i in range(k) for j in range(k)]
    flat = np.array([v or 0.0 for v in past.agg(*[s.alias(f"t{i}") for i, s in enumerate(terms)]).first()]).reshape(lags + 1, k, k)
    meat = flat[0] + sum((1 - lag / (lags + 1)) * (flat[lag] + flat[lag].T) for lag in range(1, lags + 1))
    return names, beta, np.sqrt(np.diag(inv @ meat @ inv))
