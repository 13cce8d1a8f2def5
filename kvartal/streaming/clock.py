"""The interval clock as a stream: micro-batches of any size give what the batch query gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.scratch import shared_dir


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a Parquet sink in the shared folder, with its checkpoint beside it."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/kvartal-stream-{name}-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the table as a file stream, with instants instead of local timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file stream reads folders: the table may be a file or a folder of them, so a pattern names either
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    for f in schema:
        if isinstance(f.dataType, T.TimestampNTZType):
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


def tumble(events: DataFrame, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Counts and sums of each interval and event type; an interval is emitted when the watermark passes it."""
    w = F.window("ts", f"{seconds} seconds")
    cents = F.round(F.col("value") * 100).cast("long")
    out = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return out.select(F.unix_seconds("w.start").alias("b"), "event_type", "n", "cents")


def passthrough(events: DataFrame, within_s: int) -> DataFrame:
    """Repeated deliveries of an event within a time are dropped, state being kept only that long."""
    return events.withWatermark("ts", f"{within_s} seconds").dropDuplicatesWithinWatermark(["event_id"])


#: Seconds that the stream's time is ahead of t: what comes at time 0 counts as late to a watermark.
START = 86400


class WaitLimit:
    """Persons at a stop: one row when they board, or when they have waited too long.

    Input rows: key, t (seconds), kind (0 arrives, 1 vehicle with ``seats``), id, seats; in one
    micro-batch all rows of a key are applied in order of (t, kind, id), as the clock does. The
    first in the queue sets a timer, which fires when the stream's time has passed their limit,
    whether or not their stop sees another row.
    """

    schema = "key long, id long, t long, outcome string"

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, key, rows, state):
        import pandas as pd

        queue = [tuple(x) for x in (state.get[0] if state.exists else [])]
        out = []

        def give_up(before: int) -> None:
            while queue and queue[0][0] + self.limit < before:
                t, i = queue.pop(0)
                out.append((key[0], i, t + self.limit, "gave up"))

        if state.hasTimedOut:
            give_up(state.getCurrentWatermarkMs() // 1000 - START + 1)
        else:
            # a micro-batch comes in several frames: its rows have one order
            for r in pd.concat(list(rows)).sort_values(["t", "kind", "id"]).itertuples():
                give_up(r.t)
                if r.kind == 0:
                    queue.append((int(r.t), int(r.id)))
                else:
                    for t, i in queue[: int(r.seats)]:
                        out.append((key[0], i, int(r.t), "boarded"))
                    del queue[: int(r.seats)]
        if queue:
            state.update(([list(x) for x in queue],))
            state.setTimeoutTimestamp(max((queue[0][0] + self.limit + START) * 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "id", "t", "outcome"])


def wait_limit(rows: DataFrame, limit: int, lateness: str = "0 seconds") -> DataFrame:
    """Outcomes of all who arrive, over a stream of rows keyed by stop whose t is the stream's time.

    Rows later than ``lateness`` are dropped, as the watermark has passed them. Who waits still
    when the stream ends has no outcome yet.
    """
    f = WaitLimit(limit)
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("t") + START)).withWatermark("ts", lateness)
    return timed.groupBy("key").applyInPandasWithState(f.__call__, f.schema, "queue array<array<long>>", "append", "EventTimeTimeout")
