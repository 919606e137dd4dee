"""Archives, UTF-16, dictionaries and published tables, on files written here."""

import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archives, readers, writers


@pytest.fixture
def quarters(tmp_path):
    for q, rows in (("q1", [("k1", "1"), ("k2", "2"), ("k2", "9")]), ("q2", [("k2", "20"), ("k3", "x")])):
        with zipfile.ZipFile(f"{tmp_path}/{q}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("sub.txt", "key\tvalue\n" + "".join(f"{k}\t{v}\r\n" for k, v in rows))
            z.writestr("other.txt", "no\n")
            z.writestr("empty.txt", "")
    return f"{tmp_path}/q?.zip"


def test_members_of_archives(spark, quarters):
    got = readers.read_zipped(spark, quarters, "sub.txt", "key string, value long")
    assert sorted(tuple(x)[1:] for x in got.collect()) == [(1, "k1", 1), (1, "k2", 20), (2, "k2", 2), (2, "k3", None), (3, "k2", 9)]
    assert readers.read_lines(spark, quarters).count() == 9 and readers.read_lines(spark, quarters, "empty*").count() == 0
    assert readers.read_lines(spark, quarters, "sub.txt").rdd.getNumPartitions() == 2
    first = {x.key: x.value for x in readers.chosen(got, "key", ["_file", "_position"]).collect()}
    last = {x.key: x.value for x in readers.chosen(got, "key", ["_file", "_position"], last=True).collect()}
    assert first == {"k1": 1, "k2": 2, "k3": None} and last == {"k1": 1, "k2": 20, "k3": None}


def test_a_member_is_read_as_a_stream(tmp_path):
    """40 MB of lines from 40 kB: what a reader has taken at its first batch is a small part."""
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "a line of some words\n" * 2_000_000)
    import tracemalloc

    reader = archives.ArchiveLines({"path": f"{tmp_path}/a.zip"}).reader(None)
    (part,) = reader.partitions()
    tracemalloc.start()
    first = next(batches := reader.read(part))
    assert first.num_rows == archives.BATCH and tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    batches.close()


def test_plain_gzip_and_utf16_with_skipped_rows(spark, tmp_path):
    rows = "title\nName|No\nÅsa|1\nБор|2\n"
    with open(f"{tmp_path}/a.txt", "wb") as f:
        f.write(rows.encode("utf-16"))
    with gzip.open(f"{tmp_path}/b.txt.gz", "wb") as f:
        f.write(rows.encode("utf-16"))
    got = readers.read_lines(spark, f"{tmp_path}/a.txt,{tmp_path}/b*.gz", encoding="utf-16", skip=2)
    assert sorted((x.archive[-2:], x.position, x.line) for x in got.collect()) == [("gz", 2, "Åsa|1"), ("gz", 3, "Бор|2"), ("xt", 2, "Åsa|1"), ("xt", 3, "Бор|2")]


def test_json_dictionary(spark, tmp_path):
    with open(f"{tmp_path}/t.json", "w") as f:
        json.dump({"0": {"cik_str": 7, "ticker": "A"}, "1": {"cik_str": 8, "ticker": "B"}, "2": {"cik_str": 7, "ticker": "C"}, "3": None}, f, indent=1)
    got = readers.read_json_map(spark, f"{tmp_path}/t.json", "cik_str: bigint, ticker: string")
    assert [(x._key, x.cik_str, x.ticker) for x in got.orderBy("_position").collect()] == [("0", 7, "A"), ("1", 8, "B"), ("2", 7, "C"), ("3", None, None)]
    assert {x.cik_str: x.ticker for x in readers.chosen(got, "cik_str", ["_position"]).collect()} == {7: "A", 8: "B"}


TEXTS = ["plain", None, "", ' lead and trail ', 'a "quoted", text', "two\nlines\r\nof \\ it", "é漢"]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_published_tables(spark, tmp_path, kind):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([(i, t, i / 7) for i, t in enumerate(TEXTS)], "id long, text string, v double")
    with pytest.raises(FileNotFoundError):
        writers.read_published(spark, path)
    one = writers.publish(df, path, kind)
    back = sorted(map(tuple, writers.read_published(spark, path).collect()))
    assert one["rows"] == len(TEXTS) and back == sorted(map(tuple, df.collect()))
    # The same rows in another order change nothing.
    assert writers.publish(df.orderBy(F.desc("id")).repartition(3), path, kind) == one == writers.manifest(spark, path)
    # A write that fails half-way shows nothing, and its remains go with the next one.
    broken = df.repartition(3).withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        writers.publish(broken, path, kind)
    assert sorted(map(tuple, writers.read_published(spark, path).collect())) == back
    old = writers.read_published(spark, path)
    two = writers.publish(df.where("id < 3"), path, kind)
    assert two["rows"] == 3 and two["hash"] != one["hash"] and writers.read_published(spark, path).count() == 3
    # Who still reads the version before can go on.
    assert old.count() == len(TEXTS)
    assert {n for n in os.listdir(path) if n.startswith("v-")} == {one["version"], two["version"]}
    assert writers.publish(df.limit(0), path, kind)["rows"] == 0 and writers.read_published(spark, path).count() == 0
