import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations as C


def by_hand(rows, least, longest=4):
    """Exact counts of all phrases by language, and the collocations that they give, in rank order."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, w), a in cands.items():
        over = [a2 for (l2, w2), a2 in cands.items() if l2 == lang and len(w2) > len(w) and any(w2[i : i + len(w)] == w for i in range(len(w2)))]
        if any(100 * x >= 80 * a for x in over):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    return f, sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))


def texts(seed, n=300):
    """Few words, so that phrases repeat, late words that become frequent in the last shard only, and odd signs."""
    r = random.Random(seed)
    word = lambda i: r.choice(["A", "b", "Of", "the", "Ünder", "É", "x y", "\x1c", "\x85", "n'1", "日本"] + (["late", "later"] if i > n * 0.8 else []))
    sign = lambda: r.choice([" "] * 12 + ["  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", "!?"])
    out = [(r.choice(["en", "en", "en", "de", None, ""]), "".join(word(i) + sign() for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return out + [("en", None), ("en", ""), ("en", "..."), (None, None), ("fr", "one word " * 40), ("de", "a b " * 3000)]


@pytest.mark.parametrize(("shards", "slots"), [(4, 1 << 12), (2, 2)])
def test_counts_and_scores_equal_brute_force(spark, shards, slots):
    """Any number of shards, also where all phrases share two slots of the table of steps."""
    rows = texts(shards)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'clash' as phrase", "1 as n", "2 as shard").repartition(5)
    f, want = by_hand(rows, 12)
    counts = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in C.phrase_counts(df, least=12, shards=shards, slots=slots)[0].collect()}
    assert counts == {k: v for k, v in f.items() if v >= 12}
    got = [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(df, least=12, shards=shards, slots=slots).collect()]
    assert sorted(got, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())) == want and len(want) > 60


def test_phrases_of_late_words_that_share_slots_are_counted_whole(spark):
    """A part may share its slot with an earlier phrase while its own words are frequent in the second shard only."""
    r = random.Random(53)
    rows = []
    for i in range(240):
        late = i % 4 == 3
        told = [["a", "p", "q", "c"], ["q", "s", "b", "a"], ["b", "c", "d", "e"], ["a", "b", "c", "p"]] if late else [["b", "c", "d", "e"]]
        words = [w for _ in range(r.randrange(5, 60)) for w in [r.choice("abcde" + "pqs" * late)] + r.choice(told) * (r.random() < 0.2)]
        rows.append(("en", " ".join(words)))
    f, _ = by_hand(rows, 12)
    counts = C.phrase_counts(spark.createDataFrame(rows, "lang string, text string").coalesce(1), least=12, shards=2, slots=301)[0]
    assert {(x.lang, tuple(x.phrase.split(" "))): x.n for x in counts.collect()} == {k: v for k, v in f.items() if v >= 12}


def test_what_passes_the_driver_does_not_follow_the_phrases(spark, monkeypatch):
    """Some 50,000 frequent phrases: the slots that they fill come as bits, and the tables of steps go out smaller than their slots."""
    import pickle

    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [("en", " ".join(f"w{i}" for i in range(at, at + 40))) for at in range(0, 20_000, 40)] * 2
    came, went = [], []
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, lambda self, f=getattr(DataFrame, name): (out := f(self), came.append(len(out)))[0])
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value, f=SparkContext.broadcast: (went.append(len(pickle.dumps(value))), f(self, value))[1])
    counts = C.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), least=2, slots=1 << 16)[0]
    assert 0 < sum(came) < 100 and 0 < max(went) < 3 << 16
    monkeypatch.undo()
    f, _ = by_hand(rows, 3)  # none is that frequent: only the counts are of use
    assert {(x.lang, tuple(x.phrase.split(" "))): x.n for x in counts.collect()} == f and len(f) > 70_000


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = texts(9, 900)
    spark.createDataFrame([(i % 7 or None, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op13_collocations(spark, str(tmp_path)).toPandas().sort_values(["lang", "rank"], ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(C.ORACLE_SQL["op13_collocations"]).df().sort_values(["lang", "rank"], ignore_index=True)
    assert got.equals(want[got.columns].astype(got.dtypes)) and len(got) > 100


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([("en", bytearray(b"a \xff b a \xff b"))], "lang string, text binary")
    assert {r.phrase for r in C.collocations(df, least=2).collect()} == {"a � b"}
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0


def test_long_texts():
    """Long texts are cut at pieces' ends only."""
    text = b"some words here, " * 1_500_000
    parts = list(C._pieces(text))
    assert len(parts) > 1 and b",".join(parts) == text and max(map(len, parts)) < 2 * C.CHUNK + 100
    assert list(C._pieces(b"x " * 7_000_000)) == [b"x " * 7_000_000]


def test_texts_are_cut_into_words_once(monkeypatch):
    """What every scan counts are numbered words: lots put together again give the words of their texts, and no text is cut into words then."""
    lots = [["A b, c a", "d\te"], ["e e . zz"], [""], ["b\nb", " ", "Ä é;b"]]
    numbered = [C._numbered([t.encode() for t in texts]) for texts in lots]
    monkeypatch.setattr(C, "_LOWER", None)
    words, gram = C._merged(numbered)
    assert len(set(words)) == len(words)
    got = [[]]
    for i in gram:
        got[-1].append(words[i].decode()) if i >= 0 else got.append([])
    want = [piece.split() for texts in lots for t in texts for piece in re.split("[.,;:!?\n]", t.replace("A", "a"))]
    assert [p for p in got if p] == [p for p in want if p]
    import numpy as np

    since = {k: np.zeros(16, "uint8") for k in (1, 2, 3)}
    counts = {p: n for _, phrases, ns, *_ in C._counted("en", numbered, 0, 2, [1, 2], since) for p, n in zip(phrases.to_pylist(), ns.tolist(), strict=True)}
    assert counts[b"b"] == 4 and counts[b"e e"] == 1 and counts[b"c a"] == 1 and b"b b" not in counts
