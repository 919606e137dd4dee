import math
import random

import numpy as np
import pytest

from tidemark.llm import embedding_graph as G


def all_pairs(rows, threshold):
    """(vec_id, n_links, component_id, kept) of every row, by comparing all pairs."""
    unit = []
    for _, v, label in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if ok else None)
    up, count = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(unit):
        for j in range(i):
            if a is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(a) == len(unit[j]) and a @ unit[j] >= threshold:
                count[i] += 1
                count[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[root(i)] = min(vec, least.get(root(i), vec))
    comp = [least.get(root(i)) for i in range(len(rows))]
    return sorted(((r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, count, comp, strict=True)), key=str)


def clustered(seed, groups=12, dim=24, noise=(0.02, 0.12)):
    """Groups of near copies of 2 to 60 around centres, chains of links, and single vectors."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c, s = r.normal(size=dim), r.uniform(*noise)
        for _ in range(int(r.choice([2, 3, 8, 60]))):
            out.append((c / np.linalg.norm(c) + s * r.normal(size=dim) * 1.2) * r.uniform(0.1, 9))
    for _ in range(2):
        a, b = r.normal(size=dim), r.normal(size=dim)
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        out += [a * math.cos(t) + b * math.sin(t) for t in np.arange(0, 2.5, 0.3)]
    out += list(r.normal(size=(80, dim)))
    r.shuffle(out)
    return [[float(x) for x in v] for v in out]


@pytest.mark.parametrize("first_rows", [10**6, 20])
def test_equals_all_pairs(spark, first_rows):
    """Nulls, zeros, non-finite numbers, unlike lengths, repeated ids and vectors, one shard or many of each label."""
    r = random.Random(3)
    rows = [(None if i % 41 == 7 else 10_000 - i % 300, v, i % 4 // 2) for i, v in enumerate(clustered(1) + clustered(2))]
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")], [3.0, 4.0], [0.3, 0.4], [1e-200, 2e-200], [2e200, 4e200], [-3.0, -4.0], [3.0, 4.0, 0.0]]
    rows += [(20_000 + i, v, label) for i, v in enumerate(odd) for label in (1, None)] + [(1, [3.0, 4.0], 1), (None, [6.0, 8.0], 1), (30_000, [9.0], 7), (30_000, [1.0], 7)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'clash' as row", "1 as size", "2 as shard", "3 as node").repartition(4)
    got = G.near_vectors(df, 0.93, first_rows=first_rows)
    assert sorted((tuple(x) for x in got.collect()), key=str) == all_pairs(rows, 0.93)


def test_empty(spark):
    assert G.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.93).count() == 0


def test_no_links(spark):
    got = G.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int"), 0.93)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_of_plain_walks():
    """The graph alone, without audits: links that lie apart from their node, from narrow beams."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.3 * r.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = G.Graph(x)
    assert len(g.node) > 2500 and g.top >= 1
    reached, width, recall = G.search(g, x, 0.93)
    found = sum(len(a) for a, _ in G._verified(g, x, reached, 0.93))
    there = int((x @ x.T >= 0.93).sum())
    assert there > 4000 and found >= 0.99 * there and recall >= 0.99 and width < 512
    again = G.Graph.restored(x, *[g.parts()[0], g.node, g.parts()[1], g.entry])
    assert (again.walk(x[:50], 32)[0] == g.walk(x[:50], 32)[0]).all()


def test_beams_widen():
    """A node with one neighbour only reaches little; the audit widens the beams to the whole shard."""
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 16))
    x[200:] = x[:200] + 0.2 * r.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = G.Graph(x, copy=2.0, links=2, width=4)
    narrow = G._reached(g, x, 2, 0.93)
    there = int((x @ x.T >= 0.93).sum())
    assert sum(len(a) for a, _ in G._verified(g, x, narrow, 0.93)) < 0.99 * there
    reached, width, recall = G.search(g, x, 0.93, width=2)
    assert width > 2 and recall >= 0.99
    assert sum(len(a) for a, _ in G._verified(g, x, reached, 0.93)) >= 0.97 * there


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/check_h/embeddings.parquet").where("label in (1, 5)")
    pdf = df.toPandas()
    want = {}
    for _, part in pdf.groupby("label"):
        x = np.array(part["embedding"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= dict(zip(part["vec_id"].tolist(), ((x @ x.T >= 0.93).sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in G.near_vectors(df, 0.93).collect()}
    assert all(got[k] <= v for k, v in want.items()) and sum(got.values()) >= 0.999 * sum(want.values()) > 10**5
