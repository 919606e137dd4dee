"""Event-time windows on the events table."""

from pyspark.sql import functions as F

from tidemark.plans.registry import Registry, n
from tidemark.streaming import windows as S

R = Registry()


def _events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@R.query("tumbling_window", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_window(t):
    w = S.tumbling(_events(t), "ts", "1 day", ["event_type"], "value")
    return w.select(_at("start").alias("start"), "event_type", n("n").alias("n"), F.round("total", 2).alias("total"))


@R.query("sliding_window", "SELECT strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600 - k * 21600)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events, range(4) r(k) GROUP BY 1, 2")
def sliding_window(t):
    w = S.sliding(_events(t), "ts", "1 day", "6 hours", ["event_type"])
    return w.select(_at("start").alias("start"), "event_type", n("n").alias("n"))


@R.query("session_window", """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM e)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stop, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, i""")
def session_window(t):
    w = S.sessions(_events(t), "ts", "12 hours", ["user_id"])
    return w.select(_at("start").alias("start"), _at("end").alias("stop"), "user_id", n("n").alias("n"))


@R.query("dedup_once", "SELECT user_id, count(DISTINCT event_id)::BIGINT AS n FROM events GROUP BY 1")
def dedup_once(t):
    twice = _events(t).unionByName(_events(t))
    return S.once(twice, "ts", "event_id", "1 day").groupBy("user_id").agg(n(F.count("*")).alias("n"))


QUERIES, ORACLE_SQL = R.queries, R.sql
