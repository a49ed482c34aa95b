"""Queries of event-time windows, joins of streams, repeats and limits, with their SQL.

The events are staged in four slices of arrival and read as a stream, slice by slice from one checkpoint. Some rows arrive a slice after their
time, within the delay that is allowed; others two slices after it, when their windows are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_folder
from ..streaming import windows
from .frames import registry, table

QUERIES, ORACLE_SQL, query = registry()

_SLICES = 4
_HALF = "CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END"
#: Rows close to the end of their half of the month come a slice later, within the hour allowed; a few of all come two slices later.
_ARRIVES = f"{_HALF} + CASE WHEN event_id % 41 = 7 THEN 2 WHEN event_id % 2 = 0 AND (ts >= TIMESTAMP '2024-01-15 23:30:00' AND ts < TIMESTAMP '2024-01-16 00:00:00') THEN 1 ELSE 0 END"
_TIME = windows.EventTime("ts", "1 hour")
_COLUMNS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
_MARKS = f"arr AS (SELECT *, {_ARRIVES} AS slice FROM events), marks AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM arr GROUP BY slice), final AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("slice", F.expr(_ARRIVES)).withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows for each partition of a stream's state.
_ROWS = 100_000


def _streamed(s: SparkSession, rows: DataFrame, declare=None, run=None) -> str:
    """Feeds the slices one after another to a stream that declare(stream) says, or to run(stream, path), and gives the path."""
    path, partitions = new_folder(s, "stream"), -(-rows.count() // _ROWS) or 1
    run = run or (lambda stream, p: windows.drained(declare(stream), p, partitions=min(partitions, int(s.conf.get("spark.sql.shuffle.partitions")))))
    for i in range(_SLICES):
        rows.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{path}/in")
        run(s.readStream.schema(_COLUMNS).parquet(f"{path}/in"), path)
    return path


def _plain(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select("event_id", "ts", "user_id", "event_type", "value", "slice")


_WINDOW = "timestamp, end timestamp, event_type string, n bigint, cents bigint"


@query(f"WITH {_MARKS}, w AS (SELECT a.*, date_trunc('hour', ts) AS start, m.mark FROM arr a JOIN marks m ON m.slice = a.slice) SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM w, final f WHERE (w.mark IS NULL OR start + INTERVAL 1 HOUR > w.mark) AND start + INTERVAL 1 HOUR <= f.mark GROUP BY 1, 2, 3")
def w5_tumbling_windows(s, d):
    """Closed hours of each kind of event; rows of closed hours came too late and count nowhere."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    path = _streamed(s, _plain(s, d), lambda stream: windows.tumbling(stream, _TIME, "1 hour", ["event_type"], n=F.count("*"), cents=cents))
    return windows.stored(s, path, f"start {_WINDOW}").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"WITH {_MARKS} SELECT event_id, event_type FROM arr a JOIN marks m ON m.slice = a.slice WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= m.mark")
def w5_late_rows(s, d):
    """The rows that the hours above have lost, stored on the way."""
    closes = F.date_trunc("hour", F.col("ts")) + F.expr("INTERVAL 1 HOUR")
    path = _streamed(s, _plain(s, d), run=lambda stream, p: windows.late(stream, _TIME, closes, p))
    return windows.late_rows(s, path, _COLUMNS).select("event_id", "event_type")


@query(f"WITH {_MARKS}, a AS (SELECT a.* FROM arr a JOIN marks m ON m.slice = a.slice WHERE m.mark IS NULL OR ts + INTERVAL 30 MINUTE > m.mark), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM a), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM i, final f GROUP BY user_id, nth, f.mark HAVING max(ts) + INTERVAL 30 MINUTE <= f.mark")
def w5_sessions(s, d):
    """Closed sessions of each user: events at most half an hour apart."""
    w = windows.Sessions(_TIME, "30 minutes", ("user_id",), {"n": F.count("*")})
    path = _streamed(s, _plain(s, d), run=w.read)
    out = w.closed(s, path, _COLUMNS, "start timestamp, end timestamp, user_id bigint, n bigint")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"WITH {_MARKS}, a AS (SELECT a.* FROM arr a JOIN marks m ON m.slice = a.slice WHERE m.mark IS NULL OR ts > m.mark) SELECT c.event_id AS event_id, p.event_id AS bought FROM a c JOIN a p ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def w5_interval_join(s, d):
    """Clicks with the purchases of the same user in the six hours behind them, as a join of two streams."""

    def joined(stream: DataFrame) -> DataFrame:
        clicks = stream.where("event_type = 'click'").select("user_id", "event_id", "ts")
        bought = stream.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("bought_at"))
        return windows.interval_join(clicks, bought, ["user_id"], _TIME, windows.EventTime("bought_at", "1 hour"), "6 hours")

    path = _streamed(s, _plain(s, d), joined)
    return windows.stored(s, path, "user_id bigint, event_id bigint, ts timestamp, bought bigint, bought_at timestamp").select("event_id", "bought")


@query(f"WITH {_MARKS}, twice AS (SELECT event_id, ts, slice FROM arr UNION ALL SELECT event_id, ts, slice + CASE WHEN event_id % 10 = 4 AND slice < 3 THEN 1 ELSE 0 END FROM arr WHERE event_id % 10 IN (3, 4)) SELECT DISTINCT event_id FROM twice t JOIN marks m ON m.slice = t.slice WHERE m.mark IS NULL OR ts > m.mark")
def w5_without_repeats(s, d):
    """Events that are delivered twice, some of them in the next slice, once each."""
    e = _plain(s, d)
    again = e.where("event_id % 10 IN (3, 4)").withColumn("slice", F.expr("slice + CASE WHEN event_id % 10 = 4 AND slice < 3 THEN 1 ELSE 0 END"))
    path = _streamed(s, e.unionByName(again), lambda stream: windows.without_repeats(stream, _TIME, ["event_id"]).select("event_id", "ts"))
    return windows.stored(s, path, "event_id bigint, ts timestamp").select("event_id")


