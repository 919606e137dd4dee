"""Corpus preparation: toxicity, near duplicates, benchmark decontamination, personal data, mixing.

Every stage takes what its predecessor kept, written as Parquet and read again; its decisions take effect. All but the last give the
columns of documents. Null texts pass all stages; an empty table gives an empty result. A row with a null doc_id cannot be
told from others with one, so no stage drops it.
"""

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.mixing import mix
from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.pii import pseudonymise
from tidemark.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).join(keep(ids.distinct(), "dropped").hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects (score of 0.5 or more)."""
    scores = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where("predicted = 1 and doc_id is not null").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the least id: five-word shingles, a similarity of 0.8 or more.

    Of rows that repeat an id the least by its other columns stays.
    """
    groups = near_duplicates(docs, shingle=5, percent=80)
    out = _without(docs, groups.where("not kept").select("doc_id"))
    twice = keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not twice.limit(1).count():
        return out
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")
    return out.join(twice, "doc_id", "left_anti").unionByName(again).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pseudonymise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced under the key in spark.tidemark.pii.key; n_chars follows the new text.

    Without that setting a key is drawn for the run and forgotten: values stay linked within the run and nobody can undo it.
    """
    key = spark.conf.get("spark.tidemark.pii.key", None) or secrets.token_hex(16)
    return pseudonymise(docs.select(*COLUMNS), key).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise_texts),
    ("mixing", mix_sources),
]

#: The first stage trains a classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
