"""Old and new status of payments, as a stream of changes.

Each payment keeps the events that may still be overtaken: those later than the watermark. What
lies behind the watermark is one settled status, so the state of a payment is bounded by the events
of the allowed delay, and an idle one shrinks to a row when its timer fires. A change is told at
once. If a late event then comes in between, the change after it is told again with its new old
status; readers take the newest telling of each event, which equals the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from claimweave.streaming.payment_status import known, status_events

_CHANGE = "payment_intent_id string, event_id bigint, ts timestamp, old_status string, new_status string"
# Times are microseconds since 1970 inside the state and in what leaves it, so that no time zone is involved.
_TOLD = "payment_intent_id string, event_id bigint, at bigint, old_status string, new_status string"
# The settled event, the recent ones, and the timer that is set: one value, since each call for state is a message to the JVM.
_STATE = "at bigint, event_id bigint, status string, ats array<bigint>, event_ids array<bigint>, statuses array<string>, timer bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def told(settled: tuple | None, before: list[tuple], after: list[tuple]) -> list[tuple]:
    """The changes to tell when the ordered events ``before`` become ``after``: of events that are new, or whose predecessor is."""

    def linked(events: list[tuple]) -> dict[tuple, str | None]:
        old = None if settled is None else settled[2]
        out = {}
        for event in events:
            out[event] = old
            old = event[2]
        return out

    known_links = linked(before)
    return [(event, old) for event, old in linked(after).items() if event not in known_links or known_links[event] != old]


class ChangeTracker(StatefulProcessor):
    """State of one payment: ``recent`` events in order, and the newest event behind the watermark as ``settled``."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.payment = handle.getValueState("payment", _STATE)

    def _load(self) -> tuple[tuple | None, list[tuple], int | None]:
        state = self.payment.get()
        if state is None:
            return None, [], None
        at, number, status, ats, numbers, statuses, timer = state
        return None if at is None else (at, number, status), list(zip(ats, numbers, statuses)), timer

    def _settle(self, settled: tuple | None, events: list[tuple], timer: int | None, watermark_ms: int) -> None:
        """Keeps what may still be overtaken and asks for a timer for the rest. Spark drops rows at or before the watermark, so what is settled stays."""
        final = [e for e in events if e[0] <= watermark_ms * 1000]
        open_ = events[len(final) :]
        if final:
            settled = final[-1]
        wanted = None
        if open_:
            wanted = open_[-1][0] // 1000 + 1
        elif self.idle_ms is not None and settled is not None:
            end_ms = settled[0] // 1000 + self.idle_ms
            if end_ms <= watermark_ms:
                settled = None
            else:
                wanted = end_ms + 1
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if settled is None and not open_:
            self.payment.clear()
        else:
            ats, numbers, statuses = ([event[i] for event in open_] for i in range(3))
            self.payment.update((*(settled or (None, None, None)), ats, numbers, statuses, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        settled, before, timer = self._load()
        after = sorted({*before, *((row["at"], row["event_id"], row["payment_status"]) for row in rows)})
        changes = told(settled, before, after)
        self._settle(settled, after, timer, timerValues.getCurrentWatermarkInMs())
        for (at, number, status), old in changes:
            yield Row(payment_intent_id=key[0], event_id=number, at=at, old_status=old, new_status=status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled, recent, _ = self._load()
        # Spark drops the timer that fired.
        self._settle(settled, recent, None, timerValues.getCurrentWatermarkInMs())
        return iter(())


def change_stream(events: DataFrame, delay: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """A stream of old and new status per status event, corrected where later events demand it.

    An event counts if it comes at most ``delay`` after a newer one of any payment; later ones are
    dropped by the watermark. Repeats are told once. With ``idle_ms`` a payment without events
    for that long (in event time) is forgotten, and its next event has no old status; without
    it the last status is kept for good. Events without time or id are dropped. Session setting
    needed: the RocksDB state store.
    """
    changes = status_events(events).where("ts is not null and event_id is not null").withWatermark("ts", delay)
    keyed = changes.select("payment_intent_id", "event_id", "ts", "payment_status", F.unix_micros("ts").alias("at")).groupBy("payment_intent_id")
    # Plain rows: a pandas frame for each payment would cost more than its work.
    found = keyed.transformWithState(ChangeTracker(idle_ms), _TOLD, "Append", "EventTime")
    return found.select("payment_intent_id", "event_id", F.timestamp_micros("at").alias("ts"), "old_status", "new_status")


def change_sink(events: DataFrame, path: str, checkpoint: str, delay: str = "1 day", idle_ms: int | None = None) -> DataStreamWriter:
    """A writer that keeps the told changes under ``path``, a folder per micro-batch.

    A replayed batch overwrites its folder, so the result is exactly-once. Read with ``current_changes``.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return change_stream(events, delay, idle_ms).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def current_changes(spark: SparkSession, path: str, payments: DataFrame | None = None) -> DataFrame:
    """The newest telling of every change; with ``payments``, of those that exist by now. Without any batch there are none."""
    schema = f"{_CHANGE}, epoch bigint"
    try:
        told_ = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        told_ = spark.createDataFrame([], schema)  # nothing was written yet
    newest = told_.groupBy("payment_intent_id", "event_id", "ts", "new_status").agg(F.max_by("old_status", "epoch").alias("old_status"))
    newest = newest.select("payment_intent_id", "event_id", "ts", "old_status", "new_status")
    return newest if payments is None else known(newest, payments)
