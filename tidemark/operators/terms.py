"""Term weights of texts: one and two words, a vocabulary pruned by document frequency and size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(words: str):
    """The words of an array and its pairs of neighbours, joined by a blank."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, F.concat(F.col(words), pairs)).otherwise(F.col(words))


def vocabulary(bag: DataFrame, n_docs: DataFrame, min_df: int, max_share: float, cap: int) -> DataFrame:
    """term, df, n: terms of at least min_df documents and at most max_share of all, of these the `cap` most frequent (ties: the
    smaller term). bag: id, term, c; n_docs: one row, n. No more than cap rows leave the last sort."""
    t = bag.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).where(F.col("df") >= min_df)
    t = t.crossJoin(F.broadcast(n_docs)).where(F.col("df") <= max_share * F.col("n"))
    return t.orderBy(F.desc("tf"), "term").limit(cap).select("term", "df", "n")


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 5, max_share: float = 0.9, cap: int = 200_000) -> DataFrame:
    """key, terms: array of (weight, term), the heaviest first, ties by term; one row per distinct key that has any term of the vocabulary.

    Terms are runs of two letters a-z or more in lower case, and pairs of neighbouring ones. Weights are (1 + ln tf) (ln((1 + n) / (1 + df)) + 1),
    scaled so that the squares of a document sum to 1. Null and empty texts count among the n documents only; rows of one key count
    as one document. The vocabulary is at most `cap` terms and is sent to every executor: a frequent word is no hot key.
    """
    # Texts are dealt by key, and their terms, which are many times as much, are counted where the texts then are.
    texts = docs.select(F.col(key).alias("_k"), F.lower(text).alias("t")).groupBy("_k").agg(F.collect_list("t").alias("t"))
    w = texts.select("_k", F.explode("t").alias("t")).select("_k", F.regexp_extract_all("t", F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    bag = w.select("_k", F.explode(grams("w")).alias("term")).groupBy("_k", "term").agg(F.count("*").alias("c"))
    vocab = vocabulary(bag, docs.agg(F.count_distinct(F.struct(key)).alias("n")), min_df, max_share, cap)
    x = bag.join(F.broadcast(vocab), "term").withColumn("s", (1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    x = x.groupBy("_k").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.collect_list(F.struct((-F.col("s")).alias("minus"), "term")).alias("all"))
    return x.select(F.col("_k").alias(key), F.transform(F.sort_array("all"), lambda e: F.struct((-e["minus"] / F.col("norm")).alias("weight"), e["term"].alias("term"))).alias("terms"))
