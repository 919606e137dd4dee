"""Event-time windows, late data, deduplication and state; each form takes a batch or a streaming DataFrame."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """start, keys, n, total per window. late: how long a window waits for late rows in a stream."""
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    g = df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    return df.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """start, end (of the last row), keys, n per session; a row a gap or more after the last one begins a new session."""
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return g.select(F.col("w.start").alias("start"), "end", *keys, "n")


def once(df: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Each key once: a replayed log adds nothing. In a stream, keys are remembered until the watermark passes them."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def smoothed_stream(df: DataFrame, key: str, order: str, value: str, weight: float) -> DataFrame:
    """The recursive mean (x + weight * last) / (1 + weight) per key, carried in state across micro-batches.

    Rows of a key within a micro-batch go by the order column; the state is one number per key.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        last = state.get[0] if state.exists else None
        out = []
        for v in rows[value]:
            last = v if last is None else (v + weight * last) / (1 + weight)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: k[0], order: rows[order], "smooth": out})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, smooth double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in what is there, write it and stop; the checkpoint makes a restart go on where it stood."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
