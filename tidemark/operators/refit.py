"""Models fitted again at each cut-off with what was known then, and searches over parameters validated in time."""

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.kept import keep


def as_of(df: DataFrame, day: str, event: str, cutoff: str, y: str = "y") -> DataFrame:
    """Rows before the cut-off with the label known at it: 1 if the event was reported before the cut-off."""
    at = F.lit(cutoff).cast("date")
    return df.where(F.col(day) < at).withColumn(y, F.coalesce((F.col(event) < at).cast("int"), F.lit(0)))


def rolling(df: DataFrame, day: str, event: str, cutoffs: list[str], fit: Callable[[DataFrame, DataFrame], DataFrame], y: str = "y") -> DataFrame:
    """The scores of all cut-offs in one table, with the column cutoff.

    cutoffs rise; rows from each to the next are scored by fit(train, rows), train being all earlier rows with labels as of the cut-off. The rows to be scored
    carry no label and no event, so that neither labels nor statistics from after a cut-off can reach a score. The last cut-off ends the last window.

    Every fit reads its rows many times over, so they are worked out and written once, in tasks by their size; df should have no columns beyond those that fit needs.
    """
    df = keep(df.where(F.col(day) < F.lit(cutoffs[-1]).cast("date")), "rolling")
    parts = []
    for start, end in zip(cutoffs, cutoffs[1:], strict=False):
        rows = df.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date"))).drop(event, y)
        parts.append(fit(as_of(df, day, event, start, y).drop(event), rows).withColumn("cutoff", F.lit(start)))
    return reduce(DataFrame.unionByName, parts)


def parameter_table(space: dict[str, list], trials: int, seed: int) -> list[dict]:
    """Up to trials different draws from the space, the same for a seed."""
    r, out = random.Random(seed), []
    most = reduce(lambda n, v: n * len(v), space.values(), 1)
    while len(out) < min(trials, most):
        one = {k: r.choice(v) for k, v in space.items()}
        if one not in out:
            out.append(one)
    return out


def search(train: DataFrame, valid: DataFrame, space: dict[str, list], trials: int, seed: int, seeds: list[int], fit: Callable[..., DataFrame], metric: Callable[[DataFrame], Column | float], threads: int = 4) -> list[dict]:
    """A row for each trial: its parameters and the metric of its scores on valid, averaged over the seeds before they are judged; best first.

    fit(train, valid, seed, **parameters) gives valid with columns key and score; metric(scores) a number. Trials run side by side; Spark shares the executors among them.
    """
    from concurrent.futures import ThreadPoolExecutor

    def run(one: dict) -> dict:
        parts = [fit(train, valid, s, **one) for s in seeds]
        scores = reduce(DataFrame.unionByName, parts).groupBy("key", "y").agg(F.avg("score").alias("score"))
        return one | {"metric": metric(scores)}

    with ThreadPoolExecutor(threads) as pool:
        got = list(pool.map(run, parameter_table(space, trials, seed)))
    return sorted(got, key=lambda r: -r["metric"])
