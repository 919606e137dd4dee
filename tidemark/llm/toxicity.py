"""Toxicity by weak supervision.

Many voters look at each text: one per lexicon word and one per word beginning. They vote where such words are dense, since a
single one turns up in any long text by chance. Which words and beginnings vote, and from which density on, is mined from
labelled rows; what their votes are worth is not: a generative label model is fitted on the votes of all documents, labelled or not.
Voters that fire together far more than not are one family and count once (their correlation); each family's rates of firing on
toxic and on clean texts, and so its accuracy, come from expectation maximisation. The model's posteriors are the training
labels of a linear classifier over the rates of words and beginnings, which then scores every document, also where no voter fires.
"""

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, keep, sized, table

#: A small fixed lexicon, known before any label is seen.
SEED_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Lengths of the beginnings of longer words that are patterns.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Most labelled rows, toxic and clean, that words are mined from, and most rows the classifier is fitted on; by a hash of the id.
MINED_TOXIC, MINED_CLEAN, FITTED_ROWS = 10_000, 20_000, 40_000
#: A voter occurs in SUPPORT toxic texts at least, LIFT times as often as in clean ones, with that much evidence (in nats).
SUPPORT, LIFT, EVIDENCE, VOTERS = 5, 8.0, 20.0, 300
#: What the classifier may use: more words and beginnings, on weaker evidence, at most so many.
USED_SUPPORT, USED_LIFT, USED = 3, 3.0, 20_000
EM_STEPS, FIT_STEPS, L2 = 10, 400, 1e-3
#: Densities, in words per hundred, among which the one that tells labelled texts apart best is chosen.
DENSITIES = tuple(x / 8 for x in range(1, 41))
#: Counts or remembered words per task before they are handed on or forgotten.
HELD = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """w: and the word, and b: and each beginning of it that is shorter than the word."""
    return [f"w:{word}", *(f"b:{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def _counted(batches):
    """Of how many toxic (p) and clean (q) texts a feature occurs in, per part of a batch."""
    import pyarrow as pa

    def out(p, q):
        names = list(p.keys() | q.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[x] for x in names], pa.int64()), pa.array([q[x] for x in names], pa.int64())], names=["f", "p", "q"])

    for batch in batches:
        p, q = Counter(), Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)} if text else ()
            (p if toxic else q).update(found)
            if len(p) + len(q) > HELD:
                yield out(p, q)
                p, q = Counter(), Counter()
        yield out(p, q)


def mine(docs: DataFrame, train: DataFrame) -> tuple[list[str], list[str]]:
    """docs: doc_id, text; train: doc_id, toxic (0 or 1). The voters, and what the classifier uses (voters first), both bounded.

    The drawn labels are few enough to be sent to the texts, so no text is shuffled.
    """
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    seeds = [f"w:{w}" for w in SEED_WORDS]
    if not n.get(1) or not n.get(0):
        return seeds, seeds
    drawn = F.pmod(F.xxhash64(F.lit("mine"), "doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, int(1e6 * min(1, MINED_TOXIC / n[1]))).otherwise(int(1e6 * min(1, MINED_CLEAN / n[0])))
    part = docs.join(sized(train.where(drawn)), "doc_id")
    per = part.select("toxic", "text").mapInArrow(_counted, "f string, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    pos, neg = min(n[1], MINED_TOXIC), min(n[0], MINED_CLEAN)
    per = per.withColumn("lift", (F.col("p") / pos) / ((F.col("q") + 0.5) / neg)).withColumn("nats", F.col("p") * F.log("lift"))
    best = per.where((F.col("p") >= USED_SUPPORT) & (F.col("lift") >= USED_LIFT)).orderBy(F.col("nats").desc(), "f").limit(USED).collect()
    voters = [r["f"] for r in best if r["p"] >= SUPPORT and r["lift"] >= LIFT and r["nats"] >= EVIDENCE][:VOTERS]
    voters += [s for s in seeds if s not in voters]
    return voters, voters + [r["f"] for r in best if r["f"] not in set(voters)]


def _used(names: list[str], voters: int):
    """doc_id and text to doc_id, the features in the text (f), their rates per hundred words (x) and those of voting words (dense)."""
    number = {f: i for i, f in enumerate(names)}

    class Known(dict):
        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) >= HELD:
                self.clear()
            value = self[word] = tuple(sorted(number[f] for f in word_features(word) if f in number))
            return value

    def run(batches):
        import pyarrow as pa

        known = Known()
        for batch in batches:
            ids, rates, dense = [], [], []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall(text.lower()) if text else []
                hits = [k for k in map(known.__getitem__, words) if k]
                count = sorted(Counter(i for k in hits for i in k).items())
                ids.append([i for i, _ in count])
                rates.append([min(100.0 * c / len(words), 10.0) for _, c in count])
                dense.append(100.0 * sum(k[0] < voters for k in hits) / len(words) if words else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(rates, pa.list_(pa.float64())), pa.array(dense, pa.float64())], names=["doc_id", "f", "x", "dense"]
            )

    return run


def density(used: DataFrame, train: DataFrame) -> float:
    """The density that parts toxic from clean labelled texts best: the difference of the shares above it is greatest."""
    tells = [F.coalesce(F.avg(F.when(F.col("toxic") == t, (F.col("dense") >= x).cast("int"))), F.lit(0.0)).alias(f"{t}|{i}") for i, x in enumerate(DENSITIES) for t in (0, 1)]
    got = used.select("doc_id", "dense").join(train, "doc_id").agg(*tells).first()
    gap = [got[f"1|{i}"] - got[f"0|{i}"] for i in range(len(DENSITIES))]
    best = max(gap)
    alike = [x for x, g in zip(DENSITIES, gap, strict=True) if g >= best - 0.005]
    return alike[len(alike) // 2]


def families(pairs: list[tuple[int, int, int]], single: dict[int, int], voters: int) -> list[int]:
    """A family for each voter: voters that fire on mostly the same texts (Jaccard of a half or more) are correlated and joined."""
    up = list(range(voters))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, both in pairs:
        if 2 * both >= single.get(a, 0) + single.get(b, 0) - both:
            up[root(b)] = root(a)
    return [root(x) for x in range(voters)]


def label_model(used: DataFrame, voters: int, prior: float) -> tuple[list[int], dict[int, float], float]:
    """Families, the weight of each family's vote and the log odds of a text without votes, fitted on all documents.

    used: a row per document with its feature numbers; those below `voters` are votes. What is gathered is bounded by the voters:
    pairs of them once, and per step one sum per family. Texts with the same votes are one row; those without enter by number.
    """
    import math

    n = max(1, used.count())
    fired = used.select(F.filter("f", lambda i: i < voters).alias("v")).where(F.size("v") > 0).groupBy("v").agg(F.count("*").alias("n"))
    fired = keep(fired, "votes")
    a_b = fired.select("n", "v", F.explode("v").alias("a")).select("n", "a", F.explode("v").alias("b")).where("a <= b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = [(r["a"], r["b"], r["n"]) for r in a_b.collect()]
    single = {a: c for a, b, c in both if a == b}
    of = families([x for x in both if x[0] != x[1]], single, voters)
    to_family = F.array(*[F.lit(x) for x in of])
    states = fired.select(F.array_distinct(F.transform("v", lambda i: F.element_at(to_family, i + 1))).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    states = keep(states, "vote-states")
    hits = {r["k"]: r["n"] for r in states.select(F.explode("s").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    voted = states.agg(F.sum("n").alias("n")).first()["n"] or 0
    a = {k: min(0.5, max(1e-3, 0.7 * h / (prior * n))) for k, h in hits.items()}
    b = {k: max(1e-7, 0.1 * h / n) for k, h in hits.items()}
    pi, weight, none = prior, {}, 0.0
    for _ in range(EM_STEPS):
        none = math.log(pi / (1 - pi)) + sum(math.log((1 - a[k]) / (1 - b[k])) for k in hits)
        weight = {k: math.log(a[k] / b[k]) - math.log((1 - a[k]) / (1 - b[k])) for k in hits}
        if not hits:
            break
        w = F.array(*[F.lit(weight.get(k, 0.0)) for k in range(voters)])
        odds = F.aggregate("s", F.lit(none), lambda x, k: x + F.element_at(w, k + 1))
        post = states.select("s", (F.col("n") / (1 + F.exp(-odds))).alias("p"))
        sums = post.select(F.explode(F.array_append("s", F.lit(-1))).alias("k"), "p").groupBy("k").agg(F.sum("p").alias("p"))
        grown = {r["k"]: r["p"] for r in sums.collect()}
        toxic = grown.get(-1, 0.0) + (n - voted) / (1 + math.exp(-none))
        a = {k: min(0.9, max(1e-4, grown.get(k, 0.0) / (toxic + 1))) for k in hits}
        b = {k: min(a[k] / 2, max(1e-7, (h - grown.get(k, 0.0) + 0.1) / (n - toxic + 1))) for k, h in hits.items()}
        pi = min(0.5, max(1e-4, toxic / n))
    return of, weight, none


def fit_linear(rows: list[tuple[list[int], list[float], float]], size: int):
    """Weights and bias of a logistic classifier on rates with soft labels; the rows are a bounded sample."""
    import numpy as np

    lengths = np.array([len(r[0]) for r in rows], np.int64)
    ids = np.concatenate([np.asarray(r[0], np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    rate = np.concatenate([np.asarray(r[1]) for r in rows]) if rows else np.empty(0)
    of, y = np.repeat(np.arange(len(rows)), lengths), np.array([r[2] for r in rows], np.float64)
    x, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    x[size] = -2.0
    for t in range(1, FIT_STEPS + 1 if rows else 1):
        z = x[size] + np.bincount(of, weights=x[ids] * rate, minlength=len(rows))
        err = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(ids, weights=err[of] * rate, minlength=size), err.sum()) / len(rows)
        g[:size] += L2 * x[:size] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def _scored(x):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            z = np.array([x[-1] + np.dot(x[f], r) if f else x[-1] for f, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; nulls are no label; of repeated ids the highest counts). Rows whose
    crc32(doc_id) modulo `folds` is 0 are held out: nothing is mined from their labels and the classifier is not fitted on them. A null
    or empty text has the score of a text without features. Without usable labels the voters are the seed words. Scores use
    the text alone. Further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = labels.where(crc_mod(F.col("doc_id"), folds) != 0)
    voters, names = mine(docs, train)
    used = keep(docs.mapInArrow(_used(names, len(voters)), "doc_id long, f array<int>, x array<double>, dense double").withColumn("held_out", crc_mod(F.col("doc_id"), folds) == 0), "features")
    least = density(used, train)
    share = train.agg(F.avg("toxic").alias("t")).first()["t"]
    of, weight, none = label_model(used.select(F.when(F.col("dense") >= least, F.col("f")).otherwise(F.array().cast("array<int>")).alias("f")), len(voters), min(0.3, max(0.005, share or 0.05)))

    # The posterior of the generative model, on labelled texts outside the held-out fold: a bounded sample fits the classifier.
    known = train.count()
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(1e6 * min(1, FITTED_ROWS / max(1, known)))
    sample = used.join(sized(train.select("doc_id").where(drawn)), "doc_id", "left_semi").select("f", "x", "dense").collect()

    def posterior(f: list[int]) -> float:
        import math

        return 1 / (1 + math.exp(-max(-500, min(500, none + sum(weight.get(k, 0.0) for k in {of[i] for i in f if i < len(of)})))))

    x = fit_linear([(r["f"], r["x"], posterior(r["f"] if r["dense"] >= least else [])) for r in sample], len(names))
    out = used.select("doc_id", "held_out", "f", "x").mapInArrow(_scored(x), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_weak_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_weak_toxicity": op5_weak_toxicity}
ORACLE_SQL = {}
