"""Tree ensembles grown level by level from histograms: forests with a draw per tree, boosting with missing values, boosting on undersampled rows.

A row's features are bins, with one more for a missing value. On each level one pass over the rows sums, for all open nodes of all trees at once, what a
split needs by feature and bin; the sums are merged in a shuffle, each node's best split is found where its histogram lies, and one row per node reaches
the driver. So memory is bounded by trees, nodes, features and bins, not by rows. Draws are hashes of a row's key and the tree: the same on every run
and every machine. Missing values go to the side that gains more; with equal gains the first feature, the lowest cut and the left side win.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -1


@dataclass
class Tree:
    """Nodes by number: the root is 0. feature is -1 for a leaf; a bin of at most cut goes left."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [True])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def leaf_of(self, x):
        """The node that each row of bins ends in."""
        import numpy as np

        feature, cut, miss, left, right = (np.array(v) for v in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at = np.zeros(len(x), int)
        live = np.nonzero(feature[at] >= 0)[0]
        while len(live):
            node = at[live]
            v = x[live, feature[node]]
            at[live] = np.where(np.where(v == MISSING, miss[node], v <= cut[node]), left[node], right[node])
            live = live[feature[at[live]] >= 0]
        return at

    def values(self, x):
        import numpy as np

        return np.array(self.value)[self.leaf_of(x)]


def draw(key_hash, salt: int):
    """A number from 0 to 1 for each 64-bit hash, unrelated for different salts."""
    import numpy as np

    h = np.asarray(key_hash, "int64").astype("uint64") ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) / 2.0**64


def tried(seed: int, tree: int, node: int, features: int, per_split: int | None) -> list[int]:
    """The features that a split may use."""
    import numpy as np

    if not per_split or per_split >= features:
        return list(range(features))
    rank = [draw(np.array([node * 1_000_003 + f]), seed * 7919 + tree + 1)[0] for f in range(features)]
    return sorted(sorted(range(features), key=lambda f: rank[f])[:per_split])


def cut_points(df: DataFrame, features: list[str], bins: int = 32, error: float = 0.001) -> list[list[float]]:
    """Up to bins - 1 rising cut points of each feature, at its quantiles."""
    got = df.approxQuantile(features, [i / bins for i in range(1, bins)], error)
    return [sorted(set(q)) for q in got]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], key: str, y: str) -> DataFrame:
    """h (hash of the key), y, x (bins: how many cut points are smaller; -1 where missing or not a number), with all columns of df."""
    def bin_of(f: str, points: list[float]) -> Column:
        v = F.col(f).cast("double")
        low = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < v)) if points else F.lit(0)
        return F.when(v.isNull() | F.isnan(v), MISSING).otherwise(low)

    return df.withColumns({"h": F.xxhash64(key), "y": F.col(y).cast("int"), "x": F.array(*[bin_of(f, c) for f, c in zip(features, cuts, strict=True)])})


def _arrays(pdf):
    import numpy as np

    return np.array(pdf["x"].tolist(), int).reshape(len(pdf), -1), pdf["y"].to_numpy(), pdf["h"].to_numpy()


def best_split(hist, kind: str, leaf: int, l2: float, features: list[int]):
    """(gain, feature, cut, missing left, sums left, sums right) of a node's histogram [feature, bin (missing first), (n, a, b)], or None.

    kind gini: a is weight and b that of the positives; newton: a is the sum of second, b that of first derivatives.
    """
    def good(s) -> float:
        n, a, b = s
        if kind == "newton":
            return b * b / (a + l2) if a + l2 > 0 else 0.0
        return (b * b + (a - b) * (a - b)) / a if a > 0 else 0.0

    best = None
    for f in features:
        total, miss = hist[f].sum(0), hist[f, 0]
        seen = hist[f, 1:].cumsum(0)
        for cut in range(len(seen)):
            for missing_left in (True, False) if miss[0] else (True,):
                left = seen[cut] + miss if missing_left else seen[cut]
                right = total - left
                if left[0] < leaf or right[0] < leaf:
                    continue
                gain = round(float(good(left) + good(right) - good(total)), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, cut, missing_left, left, right)
    return best


def _histograms(rows: DataFrame, trees: list[Tree], slots: list[dict], weigh, bins: int) -> DataFrame:
    """tree, slot, feature, bin, n, a, b: sums over the rows in the open nodes. weigh(x, y, h) gives for each tree two arrays (a, b); a row with a = 0 does not count."""

    def run(batches):
        import numpy as np
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            x, y, h = _arrays(pdf)
            for t, (tree, slot, (a, b)) in enumerate(zip(trees, slots, weigh(x, y, h), strict=True)):
                if not slot:
                    continue
                number = np.full(len(tree.feature), -1)
                number[list(slot)] = list(slot.values())
                at = number[tree.leaf_of(x)]
                mine = np.nonzero((at >= 0) & (a > 0))[0]
                size = len(slot) * (bins + 1)
                for f in range(x.shape[1]):
                    cell = at[mine] * (bins + 1) + x[mine, f] + 1
                    s = np.stack([np.bincount(cell, w, size) for w in (np.ones(len(mine)), a[mine], b[mine])], 1)
                    sums[t, f] = sums[t, f] + s if (t, f) in sums else s
        for (t, f), s in sums.items():
            i = np.nonzero(s[:, 0])[0]
            yield pd.DataFrame({"tree": t, "slot": i // (bins + 1), "feature": f, "bin": i % (bins + 1), "n": s[i, 0], "a": s[i, 1], "b": s[i, 2]})

    got = rows.select("x", "y", "h").mapInPandas(run, "tree int, slot int, feature int, bin int, n double, a double, b double")
    return got.groupBy("tree", "slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")])


def _splitter(numbers, last: bool, kind: str, leaf: int, l2: float, seed: int, per_split: int | None, bins: int):
    """The best split of the node whose histogram is given, as one row; feature -1 if there is none."""

    def split(pdf):
        import numpy as np
        import pandas as pd

        t, slot = int(pdf["tree"].iloc[0]), int(pdf["slot"].iloc[0])
        hist = np.zeros((int(pdf["feature"].max()) + 1, bins + 1, 3))
        hist[pdf["feature"], pdf["bin"]] = pdf[["n", "a", "b"]].to_numpy()
        got = None if last else best_split(hist, kind, leaf, l2, tried(seed, t, numbers[t][slot], len(hist), per_split))
        total = hist[0].sum(0).tolist()
        _, f, cut, miss, left, right = got or (0.0, -1, 0, True, total, total)
        return pd.DataFrame([(t, slot, f, cut, miss, total, list(left), list(right))], columns=["tree", "slot", "feature", "cut", "miss", "total", "left", "right"])

    return split


def grow(rows: DataFrame, n_trees: int, weigh, kind: str = "gini", depth: int = 6, leaf: int = 5, per_split: int | None = None, seed: int = 0, l2: float = 1.0, bins: int = 32) -> list[Tree]:
    """n_trees trees of up to depth levels below the root, all at once. See _histograms for weigh."""
    trees = [Tree() for _ in range(n_trees)]
    open_: list[list[int]] = [[0] for _ in trees]
    value = lambda s: float(-s[2] / (s[1] + l2) if kind == "newton" else s[2] / s[1]) if s[1] + (l2 if kind == "newton" else 0) > 0 else 0.0
    for level in range(depth + 1):
        slots = [{node: i for i, node in enumerate(o)} for o in open_]
        if not any(slots):
            break
        numbers, last = [list(s) for s in slots], level == depth
        if last and level:
            break

        splits = _histograms(rows, trees, slots, weigh, bins).groupBy("tree", "slot").applyInPandas(_splitter(numbers, last, kind, leaf, l2, seed, per_split, bins), "tree int, slot int, feature int, cut int, miss boolean, total array<double>, left array<double>, right array<double>")
        open_ = [[] for _ in trees]
        for r in sorted(splits.collect(), key=lambda r: (r.tree, r.slot)):  # a row a node
            tree, node = trees[r.tree], numbers[r.tree][r.slot]
            if not level:
                tree.value[0] = value(r.total)
            if r.feature < 0:
                continue
            n = len(tree.feature)
            tree.feature[node], tree.cut[node], tree.missing_left[node], tree.left[node], tree.right[node] = r.feature, r.cut, r.miss, n, n + 1
            for sums in (r.left, r.right):
                for name, v in (("feature", -1), ("cut", 0), ("missing_left", True), ("left", 0), ("right", 0), ("value", value(sums))):
                    getattr(tree, name).append(v)
            open_[r.tree] += [n, n + 1]
    return trees


def _counts(rows: DataFrame) -> tuple[int, int]:
    c = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    return c["n"], c["p"] or 0


@dataclass
class Ensemble:
    """Trees with weights. kind: mean (of the trees' values), logit (their weighted sum), vote (the weighted share that says yes)."""

    kind: str
    trees: list
    weights: list
    base: float = 0.0

    def values(self, x):
        import numpy as np

        if not self.trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)) if self.kind == "logit" else 0.5)
        if self.kind == "vote":
            return sum(w * (t.values(x) >= 0.5) for t, w in zip(self.trees, self.weights, strict=True)) / sum(self.weights)
        total = sum(w * t.values(x) for t, w in zip(self.trees, self.weights, strict=True))
        return 1 / (1 + np.exp(-np.clip(self.base + total, -700, 700))) if self.kind == "logit" else total / sum(self.weights)


def scored(rows: DataFrame, models: list[Ensemble], name: str = "score") -> DataFrame:
    """rows with the mean of the models' scores, batch by batch."""
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            x, *_ = _arrays(pdf)
            pdf[name] = sum(m.values(x) for m in models) / len(models)
            yield pdf

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def forest(rows: DataFrame, trees: int = 50, ratio: float = 1.0, depth: int = 8, leaf: int = 5, per_split: int | None = None, seed: int = 0, **options) -> Ensemble:
    """Each tree sees all positives and ratio negatives for each of them, drawn for this tree alone."""
    n, p = _counts(rows)
    share = min(1.0, ratio * p / max(1, n - p))

    def weigh(x, y, h):
        for t in range(trees):
            a = ((y == 1) | (draw(h, seed * 1_000_003 + t) < share)).astype(float)
            yield a, a * y

    return Ensemble("mean", grow(rows, trees, weigh, "gini", depth, leaf, per_split, seed, **options), [1.0] * trees)


def boosted(rows: DataFrame, rounds: int = 50, rate: float = 0.1, depth: int = 4, leaf: int = 20, l2: float = 1.0, **options) -> Ensemble:
    """Trees one after another on the derivatives of the log loss; a missing value is a value, with a side of its own at each split."""
    import math

    n, p = _counts(rows)
    model = Ensemble("logit", [], [], math.log((p + 0.5) / (n - p + 0.5)))
    for _ in range(rounds):

        def weigh(x, y, h, model=Ensemble("logit", list(model.trees), list(model.weights), model.base)):
            q = model.values(x)
            yield q * (1 - q), q - y

        model.trees += grow(rows, 1, weigh, "newton", depth, leaf, None, 0, l2, **options)
        model.weights.append(rate)
    return model


def weights_after(model: Ensemble, x, y):
    """A row's weight after the model's rounds, 1 before the first: times exp(weight of the round) for each tree that errs on it."""
    import numpy as np

    return np.exp(sum((w * ((t.values(x) >= 0.5) != (y == 1)) for t, w in zip(model.trees, model.weights, strict=True)), np.zeros(len(x))))


def round_weights(rows: DataFrame, model: Ensemble, name: str = "weight") -> DataFrame:
    """rows with the weight that the next round would give them."""
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            x, y, _ = _arrays(pdf)
            pdf[name] = weights_after(model, x, y)
            yield pdf

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def _adaptive(rows: DataFrame, bags: int, rounds: int, drawn, depth: int, leaf: int, seed: int, whole: bool, **options) -> list[Ensemble]:
    """Boosting by weight, bags of it at once. drawn(bag, round, y, h, weight, mass): which rows of a bag a round sees, mass being the weight of all
    negatives. A round's error is taken on all rows if whole, else on the rows of the bag."""
    import math

    models = [Ensemble("vote", [], []) for _ in range(bags)]

    def sums(models, old, masses, k: int):
        """By bag: weight of the rows judged, of those that the last tree errs on, of all negatives."""

        def run(batches):
            import numpy as np
            import pandas as pd

            total = np.zeros((bags, 3))
            for pdf in batches:
                x, y, h = _arrays(pdf)
                for b, (new, before) in enumerate(zip(models, old, strict=True)):
                    w = weights_after(before, x, y)
                    seen = np.ones(len(y), bool) if whole or not new.trees else drawn(b, k, y, h, w, masses[b])
                    wrong = (new.trees[-1].values(x) >= 0.5) != (y == 1) if new.trees else np.zeros(len(y), bool)
                    total[b] += [w[seen].sum(), w[seen & wrong].sum(), w[y == 0].sum()]
            yield pd.DataFrame({"bag": range(bags), "all": total[:, 0], "wrong": total[:, 1], "negative": total[:, 2]})

        got = rows.select("x", "y", "h").mapInPandas(run, "bag int, all double, wrong double, negative double").groupBy("bag").agg(*[F.sum(c).alias(c) for c in ("all", "wrong", "negative")])
        return {r.bag: r for r in got.collect()}  # a row a bag

    for k in range(rounds):
        old = [Ensemble("vote", list(m.trees), list(m.weights)) for m in models]
        first = sums([Ensemble("vote", [], []) for _ in models], old, [0.0] * bags, k)
        masses = [first[b]["negative"] if b in first else 0.0 for b in range(bags)]

        def weigh(x, y, h, old=old, masses=masses, k=k):
            for b in range(bags):
                w = weights_after(old[b], x, y)
                a = w * drawn(b, k, y, h, w, masses[b])
                yield a, a * y

        for m, t in zip(models, grow(rows, bags, weigh, "gini", depth, leaf, None, seed, **options), strict=True):
            m.trees.append(t)
        judged = sums(models, old, masses, k)
        for b, m in enumerate(models):
            error = judged[b]["wrong"] / judged[b]["all"] if b in judged and judged[b]["all"] else 0.5
            error = min(max(error, 1e-9), 1 - 1e-9)
            m.weights.append(max(0.0, round(math.log((1 - error) / error), 9)))
    return models


def rusboost(rows: DataFrame, rounds: int = 10, ratio: float = 1.0, depth: int = 3, leaf: int = 5, seed: int = 0, **options) -> Ensemble:
    """Each round sees all positives and ratio negatives for each, drawn anew by their weights; errors and weights are those of all rows."""
    _, p = _counts(rows)

    def drawn(bag, k, y, h, weight, mass):
        return (y == 1) | (draw(h, seed * 1_000_003 + k) * mass < ratio * p * weight)

    return _adaptive(rows, 1, rounds, drawn, depth, leaf, seed, True, **options)[0]


def easy_ensemble(rows: DataFrame, bags: int = 5, rounds: int = 5, ratio: float = 1.0, depth: int = 2, leaf: int = 5, seed: int = 0, **options) -> list[Ensemble]:
    """A boosted model for each bag of all positives and as many negatives, drawn once; their scores are to be averaged."""
    n, p = _counts(rows)
    share = min(1.0, ratio * p / max(1, n - p))

    def drawn(bag, k, y, h, weight, mass):
        return (y == 1) | (draw(h, seed * 1_000_003 + bag) < share)

    return _adaptive(rows, bags, rounds, drawn, depth, leaf, seed, False, **options)
