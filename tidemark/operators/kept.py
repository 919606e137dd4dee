"""Intermediate results that are read more than once, written to a folder that driver and executors share."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    On one machine, as in tests, a temporary folder does where neither is set. On a cluster that would be another folder on each
    machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return folder.rstrip("/")


#: Temporary folders by application.
_LOCAL: dict[str, str] = {}


def keep(df: DataFrame, name: str, partitionBy: str | None = None, **options) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. A run's files lie in one folder,
    named by the application, which forget removes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=partitionBy)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession):
    """Within it the shuffles of what is kept are removed when it is written, and not when the driver collects its garbage."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, before)


def forget(spark: SparkSession) -> None:
    """Removes what this application has kept; to be called when its results are written, as they read these files until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
