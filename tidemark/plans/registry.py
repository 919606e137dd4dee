"""Registration of queries with their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tables:
    """The tables of one directory; t.orders reads orders. Times without zone are read as dates where a query asks for a day."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            def run(spark, sf_dir):
                return f(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def day(col: str):
    return F.col(col).cast("date")


def text_of(col: str):
    """A date as yyyy-mm-dd, which both engines write alike."""
    return F.date_format(F.col(col).cast("date"), "yyyy-MM-dd")


def n(col):
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def r6(col):
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), 6) + F.lit(0.0)
