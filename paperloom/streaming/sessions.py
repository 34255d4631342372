"""Sessions as keyed state that expires: one state a user, a timer on event time.

`session_stream` keeps a session as a value in a state store on disk, with one timer that moves with its last event; what is
live can be read from the store beside the stream (`live_sessions`), without one that runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.shared import new_path

EXPIRED = "user_id long, n_events long, last_seen timestamp"


def expired_sessions(events: DataFrame, hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """events: a stream with user_id, ts (timestamp). A row for each session that was idle for more than so many hours
    of event time."""
    idle = hours * 3_600_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))

    watched = events.withWatermark("ts", late)
    return watched.groupBy("user_id").applyInPandasWithState(step, EXPIRED, "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


SESSION = "n_events long, first_seen long, last_seen long"
#: The store that values with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """A user's session: when it began and was last seen, in milliseconds, and its events. It ends once event time is more than
    `idle` beyond the last one; the user's next event begins another."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.session = handle, handle.getValueState("session", SESSION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, last = self.session.get() if self.session.exists() else (0, None, None)
        if last is not None:
            self.handle.deleteTimer(last + self.idle + 1)
        for b in rows:
            at = b["ts"].astype("datetime64[ms]").astype("int64")
            n += len(b)
            first = int(at.min()) if first is None else min(first, int(at.min()))
            last = int(at.max()) if last is None else max(last, int(at.max()))
        self.session.update((n, first, last))
        self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _, last = self.session.get()
        self.session.clear()
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_seen": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, target: str, checkpoint: str, hours: int = 24, late: str = "0 seconds") -> StreamingQuery:
    """events: a stream with user_id, ts (timestamp). Sessions that were idle for more than so many hours of event time are
    written to target (EXPIRED), a folder a micro-batch, so that one that runs again writes the same folder over; those that are
    live stay in the state beside the checkpoint. Runs until what is there is read. Rows without a user or time are left out."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    watched = events.filter("user_id is not null and ts is not null").withWatermark("ts", late)
    expired = watched.groupBy("user_id").transformWithStateInPandas(Sessions(hours * 3_600_000), EXPIRED, "Append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return expired.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id, n_events, last_seen of the sessions that a session_stream's state holds, by its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    return state.select(F.col("key.user_id").alias("user_id"), F.col("value.n_events").alias("n_events"), F.timestamp_millis("value.last_seen").alias("last_seen"))


def all_sessions(events: DataFrame, hours: int = 24) -> DataFrame:
    """A stream run to its end: user_id, n_events, last_seen and state, `live` or `expired`."""
    spark = events.sparkSession
    target, checkpoint = new_path(spark, "sessions"), new_path(spark, "session-state")
    session_stream(events, target, checkpoint, hours).awaitTermination()
    expired = spark.read.schema(EXPIRED).option("recursiveFileLookup", "true").parquet(target)
    return expired.withColumn("state", F.lit("expired")).unionByName(live_sessions(spark, checkpoint).withColumn("state", F.lit("live")))
