"""Event-time windows, joins of streams, repeats and limits."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import limits, windows

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp, who string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def fed(spark, path, batches, run):
    """Writes each batch of (id, minutes, who) and runs the stream over what is there; what run gave for each."""
    out = []
    for rows in batches:
        spark.createDataFrame([(i, at(m), w) for i, m, w in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out.append(run(spark.readStream.schema(SCHEMA).parquet(f"{path}/in")))
    return out


TIME = windows.EventTime("at", "10 minutes")


def test_a_late_row_is_stored_and_counts_nowhere(spark, tmp_path):
    path, closes = f"{tmp_path}/w", F.date_trunc("hour", F.col("at")) + F.expr("INTERVAL 1 HOUR")
    batches = [[(1, 5, "a"), (2, 50, "a"), (3, 75, "b")], [(4, 10, "a"), (5, 62, "b"), (6, 200, "a")], [(7, 66, "b"), (8, 199, None)]]

    def run(stream):
        windows.drained(windows.tumbling(stream, TIME, "1 hour", ["who"], n=F.count("*")), path)
        windows.late(stream, TIME, closes, path)

    fed(spark, path, batches, run)
    got = {(r.start, r.who): r.n for r in windows.stored(spark, path, "start timestamp, end timestamp, who string, n long").collect()}
    assert got == {(at(0), "a"): 2, (at(60), "b"): 2}  # the hour of 180 is open still
    assert sorted(r.id for r in windows.late_rows(spark, path, SCHEMA).collect()) == [4, 7]


def test_nothing_read_is_no_rows(spark, tmp_path):
    assert windows.stored(spark, f"{tmp_path}/none", "a int").count() == 0 and windows.late_rows(spark, f"{tmp_path}/none", "a int").count() == 0


def test_sessions_go_on_over_batches(spark, tmp_path):
    path = f"{tmp_path}/s"
    batches = [[(1, 0, "a"), (2, 4, "a"), (3, 12, "b")], [(4, 9, "a"), (5, 15, "a"), (6, 40, "b")], [(7, 100, "a")]]
    fed(spark, path, batches, lambda stream: windows.drained(windows.sessions(stream, TIME, "5 minutes", ["who"], n=F.count("*")), path))
    got = sorted((r.who, r.start, r.end, r.n) for r in windows.stored(spark, path, "start timestamp, end timestamp, who string, n long").collect())
    assert got == [("a", at(0), at(14), 3), ("a", at(15), at(20), 1), ("b", at(12), at(17), 1), ("b", at(40), at(45), 1)]


def test_a_row_in_time_joins_a_session_that_has_closed(spark, tmp_path):
    path, w = f"{tmp_path}/c", windows.Sessions(TIME, "5 minutes", ("who",), {"n": F.count("*")})
    # the watermark is 6: a's session ended at 5, its rows of 1 and before are late, that of 4 is not and belongs to it
    batches = [[(1, 0, "a"), (2, 16, "b")], [(3, 4, "a"), (4, 1, "a"), (5, 21, "b")], [(6, 35, "c")]]
    seen = lambda: sorted((r.who, r.start, r.end, r.n) for r in w.closed(spark, path, SCHEMA, "start timestamp, end timestamp, who string, n long").collect())
    got = fed(spark, path, batches, lambda stream: w.read(stream, path) or seen())
    assert got == [[("a", at(0), at(5), 1)], [("a", at(0), at(9), 2)], [("a", at(0), at(9), 2)]]
    fed(spark, path, [[(7, 100, "c")]], lambda stream: w.read(stream, path))
    assert seen() == [("a", at(0), at(9), 2), ("b", at(16), at(26), 2), ("c", at(35), at(40), 1)]


def test_interval_join_drops_state_in_time(spark, tmp_path):
    path, n = f"{tmp_path}/j", 12
    batches = [[(100 * b + i, 60 * b + i, "a" if i % 2 else "b") for i in range(20)] for b in range(n)]

    def run(stream):
        left = stream.where("id % 4 < 2").select("who", "id", "at")
        right = stream.where("id % 4 >= 2").select("who", F.col("id").alias("other"), F.col("at").alias("then"))
        return windows.held_rows(windows.drained(windows.interval_join(left, right, ["who"], TIME, windows.EventTime("then", "10 minutes"), "5 minutes", "2 minutes"), path))

    held = fed(spark, path, batches, run)
    rows = [r for b in batches for r in b]
    want = sorted((i, j) for i, m, w in rows if i % 4 < 2 for j, k, v in rows if j % 4 >= 2 and w == v and -5 <= m - k <= 2)
    assert sorted((r.id, r.other) for r in windows.stored(spark, path, "who string, id long, at timestamp, other long, then timestamp").collect()) == want
    assert max(h[-1] for h in held[2:]) <= 60 < n * 20  # state is that of the last batches, not of all
    with pytest.raises(ValueError):
        windows.interval_join(spark.range(1), spark.range(1), [], TIME, TIME, "1 minute")


def test_repeats_are_dropped_and_forgotten(spark, tmp_path):
    path = f"{tmp_path}/r"
    batches = [[(1, 0, "a"), (1, 0, "a"), (2, 3, "a")], [(2, 3, "a"), (3, 6, "b")], *[[(10 * b, 30 * b, "c")] for b in range(1, 6)]]
    held = fed(spark, path, batches, lambda stream: windows.held_rows(windows.drained(windows.without_repeats(stream, TIME, ["id"]), path)))
    ids = sorted(r.id for r in windows.stored(spark, path, SCHEMA).collect())
    assert ids == [1, 2, 3, 10, 20, 30, 40, 50] and held[-1][-1] <= 3


def walked(rows, per_window, window):
    """Admission by the rule, one request after another."""
    out, state = {}, {}
    for c, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[2], r[1])):
        out[c, i] = limits.seconds_to_wait(state.setdefault(c, deque()), t, per_window, window)
    return out


@pytest.mark.parametrize(("per_window", "window"), [(1, 60.0), (3, 60.0), (5, 7.5)])
def test_admission_equals_the_walk(spark, per_window, window):
    rng = random.Random(per_window)
    rows = [(rng.choice(["a", "b", None, ""]), i, rng.choice([rng.uniform(0, 20_000), 60.0 * rng.randint(0, 100), 64 * window * rng.randint(0, 4)])) for i in range(3000)] + [("c", 5000 + i, 100 + i / 10) for i in range(1500)]
    df = spark.createDataFrame([*rows, ("a", 9999, None)], "client string, request_id long, at double")
    out = {(r.client, r.request_id): (r.retry_after, r.admitted) for r in limits.admitted(df, per_window, window).collect()}
    assert out.pop(("a", 9999)) == (None, None)
    assert out == {k: (w, w == 0) for k, w in walked(rows, per_window, window).items()}
    assert limits.admitted(df.limit(0), per_window, window).count() == 0


def test_a_busy_client_is_many_tasks(spark):
    """A client's requests with pauses are many islands, in every partition of the shuffle."""
    df = spark.range(200_000).select(F.lit("one").alias("client"), F.col("id").alias("request_id"), (F.col("id") * 7 + F.when(F.col("id") % 50 > 25, 90).otherwise(0)).cast("double").alias("at"))
    apart = limits.islands(df).groupBy("_key", "island").agg(F.count("*").alias("n")).withColumn("task", F.spark_partition_id())
    rows = apart.agg(F.count("*").alias("islands"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count_distinct("task").alias("tasks")).first()
    assert rows["all"] == 200_000 and rows.islands > 3000 and rows.most < 100
    with pytest.raises(ValueError):
        limits.admitted(df, 0)
