"""Quality rules with risk-controlled thresholds.

Fixed base rules reject texts that are too short or repeat themselves too much. The cutoffs of further rules are learned per stratum:
they tighten together along a fixed ladder from lenient to strict, and on a labelled holdout a rung may be used only if an exact
binomial test shows, at a level corrected for all strata, that all rules together reject at most a small share of the stratum's good
documents. The first rung that fails its test ends the ladder (fixed-sequence testing), so trying many costs no further correction.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, keep, let, sized, table, words

#: A text with fewer words, or with more than this percentage of its words in repeated 3-word windows, fails the base rules.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Share of good documents that the learned rules together may reject in a stratum, and the chance that this is exceeded in any of them.
ALPHA, DELTA = 0.03, 0.05
#: Learned rules: a text is rejected if a metric exceeds the cutoff of its stratum's rung. Cutoffs by rung, from lenient to strict.
LADDER = {
    "symbol_rate": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_line_rate": [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_rate": [0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "word_length": [50.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0],
}
RUNGS = len(LADDER["symbol_rate"])


def repeated_words(w: Column, width: int = 3) -> Column:
    """How many words lie in windows of `width` words that occur twice or more in w (an array of words), first ones included.

    The windows' 64-bit hashes are sorted with their positions, so equal ones are neighbours; texts without equal windows, most of
    them, skip the sort.
    """
    hashes = F.when(F.size(w) > width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(same(s, x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))
        none = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(twice), none, step, lambda a: a["n"])

    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)), F.lit(0)).cast("long")


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs; a null text has none) and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    df = docs.withColumns(
        {
            "_s": stats,
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    df = df.withColumns({"n_words": F.col("_s.n_words"), "n_repeat_words": F.col("_s.n_repeat_words")}).drop("_s")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def metrics() -> dict[str, Column]:
    per_word = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0)), 9)
    return {"symbol_rate": per_word("n_symbols"), "dup_line_rate": per_word("n_dup_lines"), "repeat_rate": per_word("n_repeat_words"), "word_length": per_word("word_chars")}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact: terms follow from each other in logs, scaled by the running maximum."""
    import math

    odds, first = math.log(p) - math.log1p(-p), math.log1p(-p)
    start = F.struct((n * F.lit(first)).alias("t"), (n * F.lit(first)).alias("top"), F.lit(1.0).alias("s"))

    def step(a, j):
        t = a["t"] + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")) + F.lit(odds)
        top = F.greatest(a["top"], t)
        return F.struct(t.alias("t"), top.alias("top"), (a["s"] * F.exp(a["top"] - top) + F.exp(t - top)).alias("s"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.least(F.aggregate(upto, start, step, lambda a: F.exp(a["top"]) * a["s"]), F.lit(1.0))


def strictness(ladder: dict[str, list[float]]) -> Column:
    """The first rung (from 0) at which a row with the metrics is rejected; null if none rejects it."""
    first = [F.array_position(F.transform(F.array(*map(F.lit, cuts)), lambda c: (F.col(m) > c).cast("int")), F.lit(1)) for m, cuts in ladder.items()]  # noqa: B023
    return F.least(*[F.when(p > 0, p - 1) for p in first])


def controlled_rungs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA, ladder: dict[str, list[float]] = LADDER) -> DataFrame:
    """holdout: stratum and the metrics, one row per good labelled document. Gives stratum, n, rung, rejected: the strictest allowed.

    Rung i passes if P(Bin(n, alpha) <= rejected at i) is at most delta / strata; strata so small that not even a clean holdout could pass
    at delta alone are not counted. Then with a chance of 1 - delta no stratum has a rung that rejects more than alpha of its good
    documents. A stratum without an allowed rung has no row.
    """
    rungs = len(next(iter(ladder.values())))
    broken = keep(holdout.groupBy("stratum", strictness(ladder).alias("at")).agg(F.count("*").alias("c")), "broken-rungs")
    upto = [F.coalesce(F.sum(F.when(F.col("at") <= i, F.col("c"))), F.lit(0)).alias(f"k{i}") for i in range(rungs)]
    per = broken.groupBy("stratum").agg(F.sum("c").alias("n"), *upto).where(F.pow(F.lit(1 - alpha), "n") <= delta)
    tests = F.array(*[F.struct(F.lit(i).alias("rung"), F.col(f"k{i}").alias("rejected")) for i in range(rungs)])
    # A table of its own: in one step the strata would be counted after the rungs are exploded.
    per = per.crossJoin(F.broadcast(per.agg(F.count("*").alias("strata"))))
    rows = per.select("stratum", "n", "strata", F.explode(tests).alias("t")).select("stratum", "n", "strata", "t.*")
    # Beyond n * alpha rejections the test cannot pass, so the sum is never long.
    passed = F.when(F.col("rejected") <= F.col("n") * alpha, binomial_cdf(F.col("rejected"), F.col("n"), alpha) <= delta / F.col("strata")).otherwise(False)
    up_to = Window.partitionBy("stratum").orderBy("rung").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("held", F.min(passed).over(up_to)).where("held")
    return held.groupBy("stratum").agg(F.max("n").alias("n"), F.max("rung").alias("rung"), F.max_by("rejected", "rung").alias("rejected"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per row of docs: doc_id, the base counts, base_failed, stratum, failed_rules (array of strings), kept.

    labels: doc_id, quality (1: good; others and nulls are not used; repeated ids count once). The holdout are the good documents that
    pass the base rules. A null stratum is a stratum. A metric of a text without words is 0. Without labels no learned
    rule applies. Repeated rows are judged alike; further columns are not read.
    """
    slim = keep(text_stats(docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))).drop("text").withColumns(metrics()), "stats")
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rungs = controlled_rungs(slim.where("not base_failed").join(good, "doc_id", "left_semi"), alpha, delta)
    rungs = sized(keep(rungs.select(F.col("stratum").alias("of"), "rung"), "rungs"))
    df = slim.join(rungs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = [F.when(F.col(m) > F.get(F.array(*map(F.lit, cuts)), F.col("rung")), F.lit(m)) for m, cuts in LADDER.items()]
    df = df.withColumn("failed_rules", F.array_compact(F.array(*over)))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *stats, "base_failed", "stratum", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def op7_quality_rules(spark, sf_dir):
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


QUERIES = {"op7_quality_rules": op7_quality_rules}

ORACLE_SQL = {
    "op7_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, p, hash3, count(*) OVER (PARTITION BY r, hash3) AS c FROM (
  SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS hash3 FROM w WHERE len(w) >= 3)),
c AS (SELECT r, sum(least(3, coalesce(q - p, 3)))::BIGINT AS n FROM (
  SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM g WHERE c > 1) GROUP BY 1),
s AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  coalesce(round(n_symbols::DOUBLE / nullif(n_words, 0), 9), 0) AS symbol_rate, coalesce(round(n_dup_lines::DOUBLE / nullif(n_words, 0), 9), 0) AS dup_line_rate,
  coalesce(round(n_repeat_words::DOUBLE / nullif(n_words, 0), 9), 0) AS repeat_rate, coalesce(round(word_chars::DOUBLE / nullif(n_words, 0), 9), 0) AS word_length FROM s),
h AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
ladder(i, {", ".join(f"c_{m}" for m in LADDER)}) AS (VALUES {", ".join(f"({i}, {', '.join(f'{c[i]}::DOUBLE' for c in LADDER.values())})" for i in range(RUNGS))}),
k AS (SELECT stratum, i, count(*) AS n, count(*) FILTER ({" OR ".join(f"{m} > c_{m}" for m in LADDER)}) AS k FROM h, ladder GROUP BY 1, 2 HAVING pow({1 - ALPHA}, count(*)) <= {DELTA}),
b AS (SELECT *, CASE WHEN k <= n * {ALPHA} THEN list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln({1 - ALPHA}))))
    <= {DELTA} / (SELECT count(DISTINCT coalesce('v' || stratum, 'n')) FROM k) ELSE false END AS ok FROM k),
q AS (SELECT stratum, max(i) AS rung FROM (SELECT *, min(ok) OVER (PARTITION BY stratum ORDER BY i) AS held FROM b) WHERE held GROUP BY 1),
f AS (SELECT m.*, {", ".join(f"c_{m} AS cut_{m}" for m in LADDER)} FROM m LEFT JOIN q ON q.stratum IS NOT DISTINCT FROM m.stratum LEFT JOIN ladder ON ladder.i = q.rung),
o AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {m} > cut_{m} THEN '{m}' END" for m in LADDER)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM o
""",
}
