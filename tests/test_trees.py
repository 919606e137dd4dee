"""The tree ensembles against plain ones: recursion over lists of rows, sums in Python, every split tried."""

import math
import random

import pytest

from tidemark.operators import trees as T

FEATURES, BINS = ["a", "b", "c"], 8


def make(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.randrange(8), r.randrange(8), r.choice([None, r.randrange(8)])
        p = 0.75 if c is None and a > 3 else 0.5 if b > 5 else 0.05
        rows.append((i, None if r.random() < 0.1 else a, b, c, int(r.random() < p)))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = make(1)
    cuts = [[i + 0.5 for i in range(7)]] * 3
    df = spark.createDataFrame(rows, "k long, a long, b long, c long, label int").repartition(3)
    t = T.binned(df, FEATURES, cuts, "k", "label").select("k", "h", "y", "x").cache()
    return t, [(r.k, r.x, r.y, r.h) for r in t.collect()]


def plain_tree(rows, weights, kind, depth, leaf, l2, seed, tree, per_split):
    """Nested tuples (feature, cut, missing left, left, right) or a leaf's value; weights: (a, b) by row. Nodes are numbered level by level."""
    def sums(rs):
        return sum(1 for r in rs if weights[r[0]][0] > 0), sum(weights[r[0]][0] for r in rs), sum(weights[r[0]][1] for r in rs)

    def good(s):
        if kind == "newton":
            return s[2] ** 2 / (s[1] + l2)
        return (s[2] ** 2 + (s[1] - s[2]) ** 2) / s[1] if s[1] else 0.0

    def value(s):
        return -s[2] / (s[1] + l2) if kind == "newton" else s[2] / s[1] if s[1] else 0.0

    nodes = {0: [r for r in rows if weights[r[0]][0] > 0]}
    out, level, count = {}, [0], 1
    for _ in range(depth):
        below = []
        for node in level:
            rs, best = nodes[node], None
            for f in T.tried(seed, tree, node, 3, per_split):
                for cut in range(BINS):
                    for miss in (True, False) if any(r[1][f] == -1 for r in rs) else (True,):
                        left = [r for r in rs if (miss if r[1][f] == -1 else r[1][f] <= cut)]
                        right = [r for r in rs if not (miss if r[1][f] == -1 else r[1][f] <= cut)]
                        if len(left) < leaf or len(right) < leaf:
                            continue
                        gain = round(good(sums(left)) + good(sums(right)) - good(sums(rs)), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, miss, left, right)
            if best:
                out[node] = (*best[1:4], count, count + 1)
                nodes[count], nodes[count + 1] = best[4:]
                below += [count, count + 1]
                count += 2
        level = below
    return out, {n: value(sums(rs)) for n, rs in nodes.items()}


def same(tree, plain):
    splits, values = plain
    got = {i: (tree.feature[i], tree.cut[i], tree.missing_left[i], tree.left[i], tree.right[i]) for i in range(len(tree.feature)) if tree.feature[i] >= 0}
    assert got == splits
    assert all(abs(tree.value[i] - v) < 1e-9 for i, v in values.items()) and len(tree.value) == len(values)


def walk(plain, x):
    splits, values = plain
    at = 0
    while at in splits:
        f, cut, miss, left, right = splits[at]
        at = left if (miss if x[f] == -1 else x[f] <= cut) else right
    return values[at]


@pytest.mark.parametrize(("ratio", "per_split"), [(1.0, None), (0.5, 2)])
def test_forest_draws_for_each_tree(data, ratio, per_split):
    df, rows = data
    model = T.forest(df, 4, ratio, depth=3, leaf=5, per_split=per_split, seed=3, bins=BINS)
    p = sum(r[2] for r in rows)
    share, bags, plain = ratio * p / (len(rows) - p), [], []
    for t in range(4):
        bag = {r[0]: float(r[2] == 1 or T.draw([r[3]], 3 * 1_000_003 + t)[0] < share) for r in rows}
        plain.append(plain_tree(rows, {r[0]: (bag[r[0]], bag[r[0]] * r[2]) for r in rows}, "gini", 3, 5, 1.0, 3, t, per_split))
        same(model.trees[t], plain[-1])
        bags.append(frozenset(k for k, v in bag.items() if v))
        assert {r[0] for r in rows if r[2]} <= bags[-1]
        assert abs(len(bags[-1]) - p - ratio * p) < 5 * math.sqrt(p)
    assert len(set(bags)) == 4
    got = {r.k: r.score for r in T.scored(df, [model]).collect()}
    assert all(abs(got[k] - sum(walk(q, x) for q in plain) / 4) < 1e-9 for k, x, *_ in rows)


def test_boosting_equals_plain_rounds_and_uses_missing_values(data):
    df, rows = data
    model = T.boosted(df, 3, rate=0.3, depth=2, leaf=10, l2=1.0, bins=BINS)
    p = sum(r[2] for r in rows)
    f = dict.fromkeys([r[0] for r in rows], math.log((p + 0.5) / (len(rows) - p + 0.5)))
    for t in model.trees:
        q = {k: 1 / (1 + math.exp(-v)) for k, v in f.items()}
        plain = plain_tree(rows, {r[0]: (q[r[0]] * (1 - q[r[0]]), q[r[0]] - r[2]) for r in rows}, "newton", 2, 10, 1.0, 0, 0, None)
        same(t, plain)
        f = {r[0]: f[r[0]] + 0.3 * walk(plain, r[1]) for r in rows}
    got = {r.k: r.score for r in T.scored(df, [model]).collect()}
    assert all(abs(got[k] - 1 / (1 + math.exp(-v))) < 1e-9 for k, v in f.items())


def test_missing_values_carry_what_imputation_loses(spark):
    """Rows are positive where the only feature is missing; its median, put in their place, tells nothing."""
    rows = [(i, None if i % 4 == 0 else i % 16, int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, v long, label int")
    cuts = T.cut_points(df, ["v"], BINS)
    t = T.binned(df, ["v"], cuts, "k", "label")
    score = lambda d: {r.k: r.score for r in T.scored(d, [T.boosted(d, 5, rate=0.5, depth=1, leaf=5, bins=BINS)]).collect()}
    got = score(t)
    assert min(got[k] for k, _, y in rows if y) > max(got[k] for k, _, y in rows if not y)
    filled = score(T.binned(df.fillna({"v": 8}), ["v"], cuts, "k", "label"))
    assert min(filled[k] for k, _, y in rows if y) <= max(filled[k] for k, _, y in rows if not y)


def plain_boost(rows, rounds, drawn, whole, depth, leaf):
    weight, trees, alphas = {r[0]: 1.0 for r in rows}, [], []
    for k in range(rounds):
        mass = sum(weight[r[0]] for r in rows if r[2] == 0)
        seen = {r[0] for r in rows if drawn(k, r, weight[r[0]], mass)}
        tree = plain_tree(rows, {r[0]: (weight[r[0]], weight[r[0]] * r[2]) if r[0] in seen else (0.0, 0.0) for r in rows}, "gini", depth, leaf, 1.0, 0, 0, None)
        wrong = {r[0] for r in rows if (walk(tree, r[1]) >= 0.5) != (r[2] == 1)}
        judged = [r[0] for r in rows if whole or r[0] in seen]
        e = sum(weight[i] for i in judged if i in wrong) / sum(weight[i] for i in judged)
        alpha = max(0.0, round(math.log((1 - e) / e), 9))
        weight = {i: w * math.exp(alpha * (i in wrong)) for i, w in weight.items()}
        trees.append(tree)
        alphas.append(alpha)
    return trees, alphas, weight


def test_rusboost_weights_equal_plain_rounds(data):
    df, rows = data
    p = sum(r[2] for r in rows)
    model = T.rusboost(df, 3, ratio=1.5, depth=2, leaf=5, seed=2, bins=BINS)
    plain, alphas, weight = plain_boost(rows, 3, lambda k, r, w, mass: r[2] == 1 or T.draw([r[3]], 2 * 1_000_003 + k)[0] * mass < 1.5 * p * w, True, 2, 5)
    for t, q in zip(model.trees, plain, strict=True):
        same(t, q)
    assert model.weights == pytest.approx(alphas) and max(alphas) > 0
    got = {r.k: r.weight for r in T.round_weights(df, model).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in weight.items()) and len(set(round(v, 6) for v in got.values())) > 1


def test_easy_ensemble_equals_plain_bags(data):
    df, rows = data
    p = sum(r[2] for r in rows)
    models = T.easy_ensemble(df, 2, 2, depth=1, leaf=5, seed=4, bins=BINS)
    share = p / (len(rows) - p)
    for b, m in enumerate(models):
        plain, alphas, _ = plain_boost(rows, 2, lambda k, r, w, mass, b=b: r[2] == 1 or T.draw([r[3]], 4 * 1_000_003 + b)[0] < share, False, 1, 5)
        for t, q in zip(m.trees, plain, strict=True):
            same(t, q)
        assert m.weights == pytest.approx(alphas)


def test_odd_frames(spark):
    empty = T.binned(spark.createDataFrame([], "k long, v double, label int"), ["v"], [[1.0]], "k", "label")
    assert T.forest(empty, 2, depth=2, bins=4).trees[0].feature == [-1]
    one = T.binned(spark.createDataFrame([(1, float("nan"), 1), (1, None, 1), (None, 2.0, 1)], "k long, v double, label int"), ["v"], [[]], "k", "label")
    assert [r.x for r in one.collect()] == [[-1], [-1], [0]]
    assert T.scored(one, [T.forest(one, 2, depth=2, leaf=1, bins=4)]).count() == 3
