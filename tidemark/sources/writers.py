"""Writers."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Options by which a CSV file gives back each text as it was, but for a text \N, which is null.
CSV = {"header": True, "nullValue": "\\N", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_MANIFEST = "_manifest.json"


def write_block(df: DataFrame, path: str, key: str) -> None:
    """A feature block: a row per key, a nullable double per feature, sorted by key within files for cheap joins and pruning."""
    df.select(key, *[F.col(c).cast("double").alias(c) for c in df.columns if c != key]).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(text).write.mode("overwrite").text(path, compression="gzip")


def top_report(df: DataFrame, order: list, k: int = 50) -> DataFrame:
    """The k first rows with their rank; only k rows ever meet."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def markdown(rows: DataFrame) -> str:
    """A bounded report as a Markdown table; for results of top_report only."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at the path: version, kind, rows, hash, schema; None where nothing is."""
    p, system = _path(spark, f"{path}/{_MANIFEST}")
    if not system.exists(p):
        return None
    stream = system.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published rows; those of an unfinished or failed write are never among them."""
    m = manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    reader = spark.read.schema(StructType.fromJson(m["schema"]))
    return reader.options(**CSV, multiLine=True).csv(f"{path}/{m['version']}") if m["kind"] == "csv" else reader.parquet(f"{path}/{m['version']}")


def publish(df: DataFrame, path: str, kind: str = "parquet") -> dict:
    """Writes df (kind: parquet or csv) beside what readers see, counts and hashes what was written, and then swaps the manifest; returns it.

    The swap is one rename: a reader, or a job that is killed anywhere, finds the old rows or the new ones. Rows that equal the
    published ones, in any order, change nothing. The version before stays for those who still read it; older ones and remains of
    failed writes go. One writer a path at a time. Column types are those that xxhash64 takes: no maps.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    target, system = _path(spark, f"{path}/{version}")
    if kind == "csv":
        df.write.options(**CSV).csv(str(target))
    else:
        df.write.parquet(str(target))
    before = manifest(spark, path)
    new = {"version": version, "kind": kind, "schema": json.loads(df.schema.json())}
    reader = spark.read.schema(df.schema)
    back = reader.options(**CSV, multiLine=True).csv(str(target)) if kind == "csv" else reader.parquet(str(target))
    rows, digest = back.agg(F.count("*"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)"))).first()
    new |= {"rows": rows, "hash": str(digest or 0)}
    if before and all(before[k] == new[k] for k in ("kind", "schema", "rows", "hash")):
        system.delete(target, True)
        return before
    draft, _ = _path(spark, f"{path}/{_MANIFEST}.{version}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps(new, indent=1), "utf-8"))
    finally:
        out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    final, _ = _path(spark, f"{path}/{_MANIFEST}")
    # Another kind of file system object than the one above, as only this one renames over a file.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(final).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(draft), system.makeQualified(final), how)
    stay = {version, before["version"] if before else version, _MANIFEST}
    folder, _ = _path(spark, path)
    for f in system.listStatus(folder):
        if (name := f.getPath().getName()) not in stay and name.startswith(("v-", _MANIFEST)):
            system.delete(f.getPath(), True)
    return new


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir or the context's checkpoint folder. On one machine, as in
    tests, a temporary one does where neither is set; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
