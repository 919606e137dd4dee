import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates as N


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_hand(rows, k, percent):
    """doc_id to (size, component), all pairs compared; rows with one id are one document."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(i, len(s), root(i), root(i) == i) for i, s in sets]


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 80)))) for i in range(60)]
    for i in range(60, 200):
        w = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    base = [r.choice(words) for _ in range(120)]
    for i in range(200, 300):  # one large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w).upper()))
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "ONE\ttwo"), (305, "é É"), (306, "é é"), (5, rows[5][1]), (7, "quite another text than before it")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bands string, comp long")
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(df.repartition(5), shingle=k, percent=percent).collect())
    assert got == sorted(by_hand(rows, k, percent))


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (4, 2, 4, True), (9, 2, 4, False)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.near_duplicates(df.withColumn("text", F.lit(None).cast("string")).where("doc_id > 0")).where("kept").count() == 2


def test_signature_estimates_similarity():
    import numpy as np

    memo = N._WordHash()
    w = [f"x{i}" for i in range(400)]
    a, b = (N.shingle_set(" ".join(w[i : i + 300]).encode(), 3, memo) for i in (0, 60))
    windows = N._circulant(512)
    sig = [windows[(N._mixed(s + np.uint64(0x5851F42D4C957F2D)) & np.uint64(N.UNIVERSE - 1)).astype(np.int64)].min(axis=0) for s in (a, b)]
    both = len(np.intersect1d(a, b))
    assert abs(np.mean(sig[0] == sig[1]) - both / (len(a) + len(b) - both)) < 0.1


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {x.id: x.comp for x in N.connected(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
