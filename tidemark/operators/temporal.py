"""Point-in-time joins: every bound in days is an argument, and nothing on or after t enters a past window.

Spark has no range join, so a range condition beside an equality compares all pairs of a key. past_counts turns it into a
window over the union of both sides (one shuffle, sorted, no pairs); the as-of joins do the same with the last or first value
seen. Only within() makes pairs, and cuts the days into bins so that a long-lived key is compared with near bins only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _days(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def past_counts(panel: DataFrame, events: DataFrame, entity: str, t: str, event_day: str, windows: dict[str, tuple[int, int]], conds: dict[str, Column] | None = None) -> DataFrame:
    """panel with a count per window name: events of the entity from t - high to t - low days, both included.

    conds: window name to a condition on the event's columns (default: all events). The two sides are laid over each other and
    counted by range frames of one partitioning, so no pair of rows is made and an event log of any length is read once.
    """
    conds = conds or {}
    ev = events.select(F.col(entity).alias("_e"), _days(F.col(event_day)).alias("_d"), F.lit(0).alias("_p"), *[F.coalesce(conds.get(w, F.lit(True)), F.lit(False)).cast("int").alias(f"_w_{w}") for w in windows])
    row = F.struct(*[F.col(c) for c in panel.columns])
    both = panel.select(F.col(entity).alias("_e"), _days(F.col(t)).alias("_d"), F.lit(1).alias("_p"), *[F.lit(0).alias(f"_w_{w}") for w in windows], row.alias("_r"))
    both = both.unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy("_e").orderBy("_d")
    out = both.withColumns({name: F.coalesce(F.sum(f"_w_{name}").over(w.rangeBetween(-high, -low)), F.lit(0)).cast("long") for name, (low, high) in windows.items()})
    return out.where("_p = 1").select("_r.*", *windows)


def days_since_last(panel: DataFrame, events: DataFrame, entity: str, t: str, event_day: str, cap: int, name: str = "days_since") -> DataFrame:
    """panel with the days since the entity's last event strictly before t, at most cap; cap also where there is none."""
    ev = events.select(F.col(entity).alias("_e"), _days(F.col(event_day)).alias("_d"), F.lit(0).alias("_p"), _days(F.col(event_day)).alias("_v"))
    both = panel.select(F.col(entity).alias("_e"), _days(F.col(t)).alias("_d"), F.lit(1).alias("_p"), F.lit(None).cast("int").alias("_v"), F.struct(*panel.columns).alias("_r")).unionByName(ev, allowMissingColumns=True)
    last = F.max("_v").over(Window.partitionBy("_e").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1))
    out = both.withColumn(name, F.least(F.coalesce(F.col("_d") - last, F.lit(cap)), F.lit(cap)).cast("long"))
    return out.where("_p = 1").select("_r.*", name)


def asof_backward(left: DataFrame, right: DataFrame, key: str, t: str, right_day: str, values: list[str], strict: bool = True, tolerance: int | None = None, order: str | None = None) -> DataFrame:
    """left with the values of the key's latest right row before t (or at t if not strict), none older than tolerance days.

    order: right column that decides between rows of one day (the greatest wins). Adds _day of the row taken. One union and one
    sort; ties are settled by the order column and then by the values themselves.
    """
    tie = F.col(order) if order else F.lit(0)
    item = F.struct(_days(F.col(right_day)).alias("d"), tie.alias("o"), *[F.col(v) for v in values])
    r = right.select(F.col(key).alias("_k"), _days(F.col(right_day)).alias("_d"), F.lit(0).alias("_p"), item.alias("_v"))
    both = left.select(F.col(key).alias("_k"), _days(F.col(t)).alias("_d"), F.lit(1).alias("_p"), F.struct(*left.columns).alias("_r")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    out = both.withColumn("_v", F.max("_v").over(w)).where("_p = 1")
    fresh = F.lit(True) if tolerance is None else (F.col("_d") - F.col("_v.d") <= tolerance)
    return out.select("_r.*", *[F.when(fresh, F.col(f"_v.{v}")).alias(v) for v in values], F.when(fresh, F.date_from_unix_date("_v.d")).alias("_day"))


def asof_forward(left: DataFrame, right: DataFrame, key: str, t: str, right_day: str, values: list[str], within: int, order: str | None = None) -> DataFrame:
    """left with the values of the key's first right row from t on, at most `within` days later (both days included)."""
    tie = F.col(order) if order else F.lit(0)
    item = F.struct(_days(F.col(right_day)).alias("d"), tie.alias("o"), *[F.col(v) for v in values])
    r = right.select(F.col(key).alias("_k"), _days(F.col(right_day)).alias("_d"), F.lit(0).alias("_p"), item.alias("_v"))
    both = left.select(F.col(key).alias("_k"), _days(F.col(t)).alias("_d"), F.lit(1).alias("_p"), F.struct(*left.columns).alias("_r")).unionByName(r, allowMissingColumns=True)
    # From the last day back, so that a row adds to what is seen already; a frame that looks ahead is summed up again for each row.
    back = Window.partitionBy("_k").orderBy(F.desc("_d")).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.min("_v").over(back)).where("_p = 1")
    near = F.col("_v.d") - F.col("_d") <= within
    return out.select("_r.*", *[F.when(near, F.col(f"_v.{v}")).alias(v) for v in values], F.when(near, F.date_from_unix_date("_v.d")).alias("_day"))


def label_within(panel: DataFrame, events: DataFrame, entity: str, t: str, event_day: str, days: int, cutoff: str | None = None, name: str = "label") -> DataFrame:
    """panel with 1 where the entity has an event from t to t + days (both included), known before the cutoff; else 0."""
    if cutoff:
        events = events.where(F.col(event_day).cast("date") < F.lit(cutoff).cast("date"))
    out = past_counts(panel, events, entity, t, event_day, {name: (-days, 0)})
    return out.withColumn(name, (F.col(name) > 0).cast("long"))


def within(left: DataFrame, right: DataFrame, key: str, t: str, right_day: str, low: int, high: int) -> DataFrame:
    """Inner pairs of a key with right_day - t from low to high days. Right columns must not clash with left ones but for the key.

    Days are binned by the window's width; a left row meets the bins that its window touches, at most three.
    """
    width = max(1, high - low + 1)
    at = _days(F.col(t))
    left = left.withColumn("_bin", F.explode(F.sequence(F.floor((at + low) / width), F.floor((at + high) / width))))
    right = right.withColumn("_bin", F.floor(_days(F.col(right_day)) / width))
    gap = _days(F.col(right_day)) - _days(F.col(t))
    return left.join(right, [key, "_bin"]).where(gap.between(low, high)).drop("_bin")


def previous(df: DataFrame, key: str, order: list[str], values: list[str], day: str, gap: tuple[int, int] | None = None, prefix: str = "prev_", step: int = 1) -> DataFrame:
    """df with the values of the key's row `step` before (negative: after), null unless the days between lie in the gap."""
    w = Window.partitionBy(key).orderBy(*order)
    take = lambda c: F.lag(c, step).over(w)
    between = F.abs(_days(F.col(day)) - take(_days(F.col(day))))
    ok = F.lit(True) if gap is None else between.between(*gap)
    return df.withColumns({f"{prefix}{v}": F.when(ok, take(F.col(v))) for v in values})


def rounds(events: DataFrame, entity: str, event_day: str, gap: int, name: str = "opens") -> DataFrame:
    """events with whether each opens a round: the entity's first, or more than `gap` days after the one before. Of events of one day
    one opens it. Only days before an event decide, so later events change nothing."""
    w = Window.partitionBy(entity).orderBy(event_day)
    since = _days(F.col(event_day)) - F.lag(_days(F.col(event_day))).over(w)
    return events.withColumn(name, F.coalesce(since > gap, F.lit(True)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def past_sums(panel: DataFrame, events: DataFrame, entity: str, t: str, event_day: str, sums: dict[str, tuple[int, int, Column]]) -> DataFrame:
    """panel with a sum per name: (low, high, value) sums the value over the entity's events from t - high to t - low days; 0 without any.

    Laid out like past_counts. Values are added as decimals of four places, so the order of a frame's rows does not show.
    """
    value = {k: F.coalesce(v.cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)")) for k, (_, _, v) in sums.items()}
    ev = events.select(F.col(entity).alias("_e"), _days(F.col(event_day)).alias("_d"), F.lit(0).alias("_p"), *[v.alias(f"_w_{k}") for k, v in value.items()])
    both = panel.select(F.col(entity).alias("_e"), _days(F.col(t)).alias("_d"), F.lit(1).alias("_p"), F.struct(*[F.col(c) for c in panel.columns]).alias("_r")).unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy("_e").orderBy("_d")
    out = both.withColumns({k: F.coalesce(F.sum(f"_w_{k}").over(w.rangeBetween(-high, -low)).cast("double"), F.lit(0.0)) for k, (low, high, _) in sums.items()})
    return out.where("_p = 1").select("_r.*", *sums)
