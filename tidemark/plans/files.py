"""Sinks and file sources: tables are written to the shared folder and read back from there."""

from pyspark.sql import functions as F

from tidemark.plans.registry import Registry, day, n, text_of
from tidemark.sources import readers, writers

R = Registry()


@R.query("block_write", "SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END::DOUBLE AS closed FROM orders")
def block_write(t):
    """A feature block: a row per key, null where a feature is not known."""
    path = writers.shared_folder(t.spark)
    writers.write_block(t.orders.select("o_orderkey", "o_totalprice", F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END").alias("closed")), path, "o_orderkey")
    return t.spark.read.parquet(path)


@R.query("append_log", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def append_log(t):
    """A job that was stopped after the finished orders, and is run again: the log holds each order once."""
    path = writers.shared_folder(t.spark)
    todo = t.orders.select("o_orderkey", text_of("o_orderdate").alias("day"), "o_orderstatus")
    writers.append_log(todo.where("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    log = lambda: readers.read_json_lines(t.spark, path, "o_orderkey long, day string")
    writers.append_log(readers.not_done(todo.drop("o_orderstatus"), log(), "o_orderkey"), path)
    return log()


@R.query("csv_write", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name || ', \"' || c_mktsegment || '\"' || chr(10) || ' ' END AS note, c_acctbal FROM customer")
def csv_write(t):
    """Texts with quotes, commas, line feeds and blanks, and nulls, through a published CSV file."""
    path = writers.shared_folder(t.spark)
    note = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\n ')))
    writers.publish(t.customer.select("c_custkey", note.alias("note"), "c_acctbal"), path, "csv")
    return writers.read_published(t.spark, path)


@R.query("publish_rewrite", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders")
def publish_rewrite(t):
    """A table that is published in part first and then rewritten whole."""
    path = writers.shared_folder(t.spark)
    rows = t.orders.select("o_orderkey", text_of("o_orderdate").alias("day"), "o_totalprice")
    writers.publish(rows.where(day("o_orderdate") < F.lit("1996-01-01").cast("date")), path)
    writers.publish(rows, path)
    return writers.read_published(t.spark, path)


@R.query("publish_manifest", "SELECT o_orderpriority, (SELECT count(*) FROM lineitem)::BIGINT AS published, true AS unchanged, count(*)::BIGINT AS orders FROM orders GROUP BY 1")
def publish_manifest(t):
    """What the manifest says of the lines, before and after a second run that brings the same rows in another order."""
    path = writers.shared_folder(t.spark)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    one = writers.publish(rows, path)
    two = writers.publish(rows.repartition("l_linenumber"), path)
    per = t.orders.groupBy("o_orderpriority").agg(n(F.count("*")).alias("orders"))
    return per.select("o_orderpriority", F.lit(one["rows"]).cast("long").alias("published"), F.lit(one == two).alias("unchanged"), "orders")


@R.query("gzip_lines", "SELECT c_custkey, c_name AS name FROM customer")
def gzip_lines(t):
    """Documents in gzip files, read as streams of lines."""
    path = writers.shared_folder(t.spark)
    writers.write_documents(t.customer.select(F.concat_ws("|", "c_custkey", "c_name").alias("text")), path)
    parts = F.split("line", r"\|", 2)
    return readers.read_lines(t.spark, f"{path.removeprefix('file://')}/*.gz").select(parts[0].cast("long").alias("c_custkey"), parts[1].alias("name"))


@R.query("pipe_mapping", "SELECT p AS part, s AS supplier FROM (SELECT 'P' || lpad(l_partkey::VARCHAR, 8, '0') AS p, l_suppkey AS s, l_orderkey AS o, l_linenumber AS l FROM lineitem) QUALIFY row_number() OVER (PARTITION BY p ORDER BY o, l, s) = 1")
def pipe_mapping(t):
    """The first value of each key of nine signs in pipe-separated files; other rows are none."""
    path = writers.shared_folder(t.spark)
    row = F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")), "l_suppkey", "l_linenumber")
    broken = F.concat_ws("|", F.lit("0"), F.col("l_partkey"), F.lit("-1"), F.lit("0"))
    t.lineitem.select(F.explode(F.array(row, broken)).alias("text")).write.text(path)
    cells = F.split("line", r"\|")
    lines = readers.read_lines(t.spark, f"{path.removeprefix('file://')}/*.txt").where(F.size(cells) == 4)
    lines = lines.select(cells[0].alias("o"), cells[3].cast("int").alias("l"), cells[2].cast("long").alias("s"), cells[1].alias("part"), cells[2].cast("long").alias("supplier"))
    return readers.chosen(lines.where(F.length("part") == 9), "part", ["o", "l", "s"])


QUERIES, ORACLE_SQL = R.queries, R.sql
