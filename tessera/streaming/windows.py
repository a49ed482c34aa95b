"""Event-time windows, joins of streams and repeats, with watermarks; late rows are stored, not lost.

A stream is declared with its event time and how late a row may be. Windows are closed, and state is dropped, when the watermark (the greatest time
seen so far less that delay) has passed them. Streams here are run until what is available has been read, and go on where
they stopped the next time: the checkpoint says what has been read, and each batch is written once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Files


@dataclass(frozen=True)
class EventTime:
    """The column that says when a row's event happened, and how late it may come."""

    column: str
    delay: str

    def marked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.column, F.col(self.column).cast("timestamp")).withWatermark(self.column, self.delay)


def tumbling(rows: DataFrame, time: EventTime, length: str, keys: Iterable[str], **sums: Column) -> DataFrame:
    """start, end and the sums of each key and window of one length; a row of a closed window is late and counts nowhere."""
    w = F.window(time.column, length)
    out = time.marked(rows).groupBy(w, *keys).agg(*(c.alias(n) for n, c in sums.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *sums)


def sessions(rows: DataFrame, time: EventTime, gap: str, keys: Iterable[str], **sums: Column) -> DataFrame:
    """start, end (the last event plus the gap) and the sums of each key's sessions: events at most the gap apart.

    As Spark has it, a session that has been given out is not opened again; Sessions does that.
    """
    w = F.session_window(time.column, gap)
    out = time.marked(rows).groupBy(w, *keys).agg(*(c.alias(n) for n, c in sums.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *sums)


@dataclass(frozen=True)
class Sessions:
    """sessions() that a row which is not late still joins after they have closed.

    A row is late once the watermark has passed it by the gap, a session closes when it has passed the last event by the gap; so for another gap
    a row in time may be near to a closed session. The rows of a session are held until none can be; what has closed by now is read from
    the settled sessions and from the rows held. A batch's files bear its number, so a batch that is run again replaces its own.
    """

    time: EventTime
    gap: str
    keys: tuple[str, ...]
    sums: dict[str, Column]

    def read(self, rows: DataFrame, path: str) -> None:
        """Reads what is available."""
        spark, files, at, gap = rows.sparkSession, Files(rows.sparkSession, path), F.col(self.time.column), F.expr(f"INTERVAL {self.gap}")
        by = Window.partitionBy(*self.keys).orderBy(at)

        def step(batch: DataFrame, number: int) -> None:
            earlier, mark = _marked_before(spark, path, number)
            own = batch.agg(F.max(at)).first()[0]
            limit, now = (F.lit(x).cast("timestamp") - F.expr(f"INTERVAL {self.time.delay}") for x in (mark, max((x for x in (mark, own) if x), default=None)))
            rows = batch if mark is None else batch.where(at + gap > limit)
            before = f"{path}/held/{earlier[-1]}/_settled=false" if earlier else None
            if before and files.exists(before):
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(before))
            fresh = F.coalesce((at - F.lag(at).over(by) > gap).cast("long"), F.lit(1))
            nth = rows.withColumn("_fresh", fresh).withColumn("_nth", F.sum("_fresh").over(by))
            last = F.max(at).over(Window.partitionBy(*self.keys, "_nth"))
            settled = F.coalesce(last + gap + gap <= now, F.lit(False))
            nth.withColumn("_settled", settled).drop("_fresh").write.mode("overwrite").partitionBy("_settled").parquet(f"{path}/held/batch={number}")
            done = f"{path}/held/batch={number}/_settled=true"
            if files.exists(done):
                self._summed(spark.read.schema(nth.drop("_fresh").schema).parquet(done)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
                files.remove(done)
            _mark(batch, at, path, number)

        query = rows.withColumn(self.time.column, at.cast("timestamp")).writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _summed(self, rows: DataFrame) -> DataFrame:
        at = F.col(self.time.column)
        out = rows.groupBy(*self.keys, "_nth").agg(F.min(at).alias("start"), (F.max(at) + F.expr(f"INTERVAL {self.gap}")).alias("end"), *(c.alias(n) for n, c in self.sums.items()))
        return out.select("start", "end", *self.keys, *self.sums)

    def closed(self, spark: SparkSession, path: str, schema: str, result: str) -> DataFrame:
        """The sessions of what read() has taken in that have closed; schema: of the rows, result: of the sessions."""
        found = [n for n in Files(spark, path).names(f"{path}/rows") if n.startswith("batch=")]
        out = spark.read.schema(result).parquet(*(f"{path}/rows/{n}" for n in found)) if found else spark.createDataFrame([], result)
        batches, mark = _marked_before(spark, path)
        held = f"{path}/held/{batches[-1]}/_settled=false" if batches else None
        if not held or not Files(spark, path).exists(held):
            return out
        still = self._summed(spark.read.schema(f"{schema}, _nth bigint").parquet(held))
        return out.unionByName(still.where(F.col("end") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {self.time.delay}")))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: EventTime, right_time: EventTime, before: str, after: str = "0 seconds") -> DataFrame:
    """Pairs with equal keys whose left event is at most `before` earlier and `after` later than the right one.

    Both sides are watermarked and the times bound each other, so a row's state is dropped once no later row can meet it. Columns
    other than the keys must differ in name.
    """
    if left_time.column == right_time.column:
        raise ValueError("the two times need different names")
    l, r = left_time.marked(left).alias("_l"), right_time.marked(right).alias("_r")  # noqa: E741
    near = (F.col(f"_l.{left_time.column}") >= F.col(f"_r.{right_time.column}") - F.expr(f"INTERVAL {before}")) & (F.col(f"_l.{left_time.column}") <= F.col(f"_r.{right_time.column}") + F.expr(f"INTERVAL {after}"))
    for k in keys:
        near = near & (F.col(f"_l.{k}") == F.col(f"_r.{k}"))
    return l.join(r, near).select(*(F.col(f"_l.{c}") for c in left.columns), *(F.col(f"_r.{c}") for c in right.columns if c not in keys))


def without_repeats(rows: DataFrame, time: EventTime, keys: list[str]) -> DataFrame:
    """The first row of each key; one that comes again within the delay of its event is dropped, and keys are forgotten after it."""
    return time.marked(rows).dropDuplicatesWithinWatermark(keys)


def drained(out: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> list[dict]:
    """Reads what is available into a Parquet table at path/rows, with its checkpoint beside it; the progress of each batch.

    partitions: of the state, which stay as they are at the first run; else the session's. Each is a task and files in every batch.
    """
    conf, name = out.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(partitions or before))
    try:
        query = _started(out, path, mode)  # it keeps the settings it was started with
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]


def _started(out: DataFrame, path: str, mode: str) -> StreamingQuery:
    return out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What drained() has written so far; no rows if that is nothing."""
    files = Files(spark, path)
    if not files.exists(f"{path}/rows/_spark_metadata"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows")


def held_rows(progress: list[dict]) -> list[int]:
    """Rows of state held after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


def _marked_before(spark: SparkSession, path: str, number: int | None = None) -> tuple[list[str], datetime | None]:
    """The batches before this one (all, if none is given), in order, and the greatest time in them."""
    found = sorted((n for n in Files(spark, path).names(f"{path}/marks") if n.startswith("batch=") and (number is None or int(n[6:]) < number)), key=lambda n: int(n[6:]))
    return found, spark.read.schema("mark timestamp").parquet(*(f"{path}/marks/{n}" for n in found)).agg(F.max("mark")).first()[0] if found else None


def _mark(batch: DataFrame, at: Column, path: str, number: int) -> None:
    batch.agg(F.max(at).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")


def late(rows: DataFrame, time: EventTime, closes: Column, path: str) -> None:
    """Reads what is available, and writes to path/late the rows that come after the watermark has passed what they belong to.

    closes: when that closes, such as a window's end. The watermark is that of the batches before, as the streams above have it; a batch's own mark
    and its late rows are written under the batch's number, so a batch that is run again replaces its own.
    """
    spark = rows.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        limit = F.lit(_marked_before(spark, path, number)[1]).cast("timestamp") - F.expr(f"INTERVAL {time.delay}")
        batch.where(closes <= limit).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        _mark(batch, F.col(time.column), path, number)

    query = rows.withColumn(time.column, F.col(time.column).cast("timestamp")).writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/late-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What late() has written so far."""
    found = [n for n in Files(spark, path).names(f"{path}/late") if n.startswith("batch=")]
    return spark.read.schema(schema).parquet(*(f"{path}/late/{n}" for n in found)) if found else spark.createDataFrame([], schema)
