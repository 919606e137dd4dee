"""Readers with declared schemas; what does not parse becomes null or is dropped, as each reader says."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import archives


def read_delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = "\t", encoding: str = "UTF-8", with_file: bool = False) -> DataFrame:
    """Text tables with a header line. All columns are read as the schema says; broken values are null. with_file adds _file, the
    path, for rules by which a later file wins."""
    df = spark.read.csv(paths, schema=schema, sep=sep, header=True, encoding=encoding, mode="PERMISSIVE")
    return df.withColumn("_file", F.input_file_name()) if with_file else df


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """A record per line; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_matching_rows(spark: SparkSession, paths: str | list[str], pattern: str, groups: dict[str, int], encoding: str = "UTF-8") -> DataFrame:
    """Lines that match the pattern, with the named groups as columns; other lines (titles, rules) are dropped."""
    lines = spark.read.option("encoding", encoding).text(paths)
    return lines.where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, g).alias(c) for c, g in groups.items()])


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row per file, gzip or plain: path and text."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, member: str = "*", encoding: str = "utf-8", skip: int = 0) -> DataFrame:
    """archive, member, position, line of files in zip archives, gzip or plain files, a task per member; no archive is held in memory."""
    spark.dataSource.register(archives.ArchiveLines)
    return spark.read.format("archive_lines").options(member=member, encoding=encoding, skip=str(skip)).load(path)


def read_zipped(spark: SparkSession, paths: str | list[str], member: str, schema: str, sep: str = "\t", encoding: str = "utf-8", skip: int = 1) -> DataFrame:
    """Members of zip files as delimited tables, after `skip` lines of titles, with _file and _position, by which a rule may choose."""
    lines = read_lines(spark, paths if isinstance(paths, str) else ",".join(paths), member, encoding, skip)
    return lines.select("archive", "position", F.from_csv("line", schema, {"sep": sep, "mode": "PERMISSIVE"}).alias("r")).select(F.col("archive").alias("_file"), F.col("position").alias("_position"), "r.*")


def chosen(lines: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """A row per key: the first in the given order (say file and position), or the last. A partial minimum; rows of a null key are left out."""
    best = (F.max_by if last else F.min_by)(F.struct(*[c for c in lines.columns if c not in order]), F.struct(*order))
    return lines.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best.alias("r")).select("r.*")


def read_json_map(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """_key, _position and the fields of each record of files that hold one JSON dictionary of records, in the order of the file."""
    whole = spark.read.text(paths, wholetext=True)
    each = whole.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string, struct<{schema}>>"))).alias("_position", "e"))
    return each.select(F.col("e.key").alias("_key"), F.col("_position").cast("long").alias("_position"), "e.value.*")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an append-only log does not hold yet: re-running a job does each key once."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
