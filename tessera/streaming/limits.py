"""Admission by a sliding window per client and a daily budget over all.

A request's admission depends on earlier admissions, so no window function can express it. But a request that comes a whole window after the
one before it owes nothing to what went before: a client's requests fall into islands that are judged apart, each by a fold over
its times in order, whose state is the admitted times of one window. The daily budget alone is a running count. Both together need one
clock over all clients; Limiter is that sequential rule, for a service.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 60.0
SCHEMA = "client string, request_id bigint, at double, admitted boolean, retry_after int"


def seconds_to_wait(times: deque, now: float, per_window: int, window: float = WINDOW) -> int:
    """0 if a request is admitted now, and its time is kept; else the whole seconds until one would be. Times out of the window are forgotten."""
    while times and now - times[0] >= window:
        times.popleft()
    if len(times) < per_window:
        times.append(now)
        return 0
    return max(1, math.ceil(window - (now - times[0])))


@dataclass
class Limiter:
    """The rule for a service, one request at a time: a refusal by either limit counts against neither."""

    per_window: int | None = None
    daily_budget: int | None = None
    window: float = WINDOW
    recent: dict[str, deque] = field(default_factory=dict)
    counted: dict[object, int] = field(default_factory=dict)
    swept: float = -math.inf

    def check(self, client: str, now: float, day: object = None, to_midnight: float = 86400.0) -> tuple[bool, int, str | None]:
        """(admitted, seconds to retry after, which limit refused)."""
        if now - self.swept >= self.window:  # clients that have been idle for a window are forgotten
            self.recent, self.swept = {c: t for c, t in self.recent.items() if t and now - t[-1] < self.window}, now
        self.counted = {day: self.counted.get(day, 0)}
        times = self.recent.setdefault(client, deque())
        if self.per_window is not None and (wait := seconds_to_wait(times, now, self.per_window, self.window)):
            return False, wait, "window"
        if self.daily_budget is not None and self.counted[day] >= self.daily_budget:
            if self.per_window is not None:
                times.pop()  # the budget refused what the window had let through
            return False, max(1, math.ceil(to_midnight)), "budget"
        self.counted[day] += 1
        return True, 0, None


#: Windows in a span of time within which a client's requests are ordered, and requests in a fold's block.
SPAN, BLOCK = 64, 512


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def waits(times: Column, per_window: int, window: float = WINDOW) -> Column:
    """For each of an array of times in order 0 if it is admitted, else the whole seconds until a request would be.

    A fold in blocks, so that what is appended to stays short however long the array is.
    """
    none, numbers = F.array().cast("array<double>"), F.array().cast("array<int>")

    def judged(state: Column, now: Column, live: Column) -> Column:
        free = F.size(live) < per_window
        wait = F.when(free, 0).otherwise(F.greatest(F.lit(1), F.ceil(window - (now - F.get(live, 0))).cast("int")))
        return F.struct(F.when(free, F.array_append(live, now)).otherwise(live).alias("times"), F.array_append(state["out"], wait).alias("out"))

    def step(state: Column, now: Column) -> Column:
        return _bound(F.filter(state["times"], lambda t: now - t < window), lambda live: judged(state, now, live))

    def block(state: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(state["times"].alias("times"), numbers.alias("out")), step)
        return _bound(done, lambda d: F.struct(d["times"].alias("times"), F.array_append(state["out"], d["out"]).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(times) - 1) / BLOCK).cast("int")), lambda i: F.slice(times, i * BLOCK + 1, BLOCK))
    folded = F.aggregate(blocks, F.struct(none.alias("times"), F.array().cast("array<array<int>>").alias("out")), block)
    return F.when(F.size(times) > 0, F.flatten(folded["out"])).otherwise(numbers)


def islands(requests: DataFrame, window: float = WINDOW) -> DataFrame:
    """client, request_id, at and island: the number of its client's requests so far that came a window or more after the one before.

    A client's requests are ordered within spans of time, and spans by their first and last request, so a client with
    most of the requests is many tasks. A null client is a client.
    """
    rows = requests.select(F.col("client").cast("string").alias("client"), "request_id", F.col("at").cast("double").alias("at"))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "client"), F.lit(""))).withColumn("_span", F.floor(F.col("at") / (SPAN * window)))
    order = Window.partitionBy("_key", "_span").orderBy("at", "request_id")
    spans = Window.partitionBy("_key").orderBy("_span")  # a row a span
    last = rows.groupBy("_key", "_span").agg(F.max("at").alias("_last")).withColumn("_before", F.lag("_last").over(spans)).drop("_last")
    near = rows.withColumn("_prev", F.lag("at").over(order)).join(last, ["_key", "_span"]).withColumn("_prev", F.coalesce("_prev", "_before"))
    fresh = near.withColumn("_fresh", F.when(F.col("at") - F.col("_prev") < window, 0).otherwise(1)).withColumn("_nth", F.sum("_fresh").over(order))
    starts = fresh.groupBy("_key", "_span").agg(F.sum("_fresh").alias("_n"))
    base = starts.withColumn("_base", F.coalesce(F.sum("_n").over(spans.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return fresh.join(base, ["_key", "_span"]).select("client", "request_id", "at", "_key", (F.col("_base") + F.col("_nth")).alias("island"))


def admitted(requests: DataFrame, per_window: int, window: float = WINDOW) -> DataFrame:
    """Which requests a per-client sliding window admits. requests: client, request_id, at (seconds).

    Requests of one time are taken by request_id. A request without a time is neither admitted nor refused (nulls). What stays in one
    task is one island: requests that follow one another without a pause of a window.
    """
    if per_window < 1 or window <= 0:
        raise ValueError("a window admits one request at least")
    timed = islands(requests.where(F.col("at").isNotNull()), window)
    each = timed.groupBy("_key", "island").agg(F.first("client").alias("client"), F.array_sort(F.collect_list(F.struct("at", "request_id"))).alias("r"))
    judged = each.select("client", F.explode(F.arrays_zip("r", waits(F.transform("r", lambda x: x["at"]), per_window, window).alias("wait"))).alias("x"))
    out = judged.select("client", "x.r.request_id", "x.r.at", (F.col("x.wait") == 0).alias("admitted"), F.col("x.wait").alias("retry_after"))
    untimed = requests.where(F.col("at").isNull()).select(F.col("client").cast("string").alias("client"), "request_id", F.lit(None).cast("double").alias("at"), F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("int").alias("retry_after"))
    return out.unionByName(untimed)


def offered(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Each request with the number of its client's requests in the window that ends with it, itself included."""
    w = Window.partitionBy("client").orderBy(F.col("at_us")).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("n_offered", F.count("*").over(w))


def within_budget(requests: DataFrame, budget: int) -> DataFrame:
    """Requests of a UTC day up to the budget, in order of time, the window limit being off.

    A day's requests would be one hot group, so its rank is taken in two steps: by minute within the day,
    then by the running count of minutes (1,440 rows a day).
    """
    rows = requests.withColumn("day", F.to_date("ts")).withColumn("minute", F.date_trunc("minute", "ts"))
    counts = rows.groupBy("day", "minute").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))).select("day", "minute", F.coalesce("before", F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("minute").orderBy("ts", "request_id"))
    return rows.withColumn("_nth", nth).join(before, ["day", "minute"]).withColumn("nth", F.col("before") + F.col("_nth")).withColumn("admitted", F.col("nth") <= budget).drop("_nth", "before", "minute")


def admitted_stream(requests: DataFrame, per_window: int, window: float = WINDOW) -> DataFrame:
    """The sliding window over a stream: a client's admitted times are its state, dropped when the watermark is a window past the last of them.

    requests: client, request_id, ts (event time, watermarked by the caller).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        q = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        at = rows["ts"].astype("int64").to_numpy() / (1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1e6)
        wait = [seconds_to_wait(q, t, per_window, window) for t in at.tolist()]
        state.update((list(q),))
        state.setTimeoutTimestamp(max(math.ceil((q[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].to_numpy(), "at": at, "admitted": [w == 0 for w in wait], "retry_after": wait})

    return requests.groupBy("client").applyInPandasWithState(step, SCHEMA, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_stream(attempts: DataFrame) -> DataFrame:
    """A stream of attempts reduced to each document's latest success so far (update or complete mode)."""
    latest = F.max_by(F.struct("id", "extracted_at"), F.struct("extracted_at", "id"))
    return attempts.where(F.col("extraction_status") == "success").groupBy("document_id").agg(latest.alias("r")).select("document_id", "r.id", "r.extracted_at")
