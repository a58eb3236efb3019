"""Payment status from webhook events, in batch and in Structured Streaming.

A status is the one of the newest event by (event time, event id). Taking the
maximum of that pair is unmoved by repeats, order and lateness, so nothing has to
be dropped and no watermark is needed for a right result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimweave.functions.ordered import previous_value

# The event types that set a status. Failed payments are only logged.
STATUS_OF = {"checkout.session.completed": "completed", "checkout.session.expired": "expired"}

_COLUMNS = ["payment_status", "session_id", "payment_intent", "ts", "event_id"]
_DELTA = "payment_intent_id string, payment_status string, session_id string, payment_intent string, ts timestamp, event_id bigint"


def status_events(events: DataFrame) -> DataFrame:
    """Events that set the status of a payment; all others are ignored. For streams and batches."""
    kinds = F.create_map(*[F.lit(part) for item in STATUS_OF.items() for part in item])
    completed = F.col("type") == "checkout.session.completed"
    return events.filter(F.col("type").isin(*STATUS_OF) & (F.coalesce("client_reference_id", F.lit("")) != "")).select(
        F.col("client_reference_id").alias("payment_intent_id"),
        F.try_element_at(kinds, F.col("type")).alias("payment_status"),
        F.when(completed, F.col("session_id")).alias("session_id"),
        F.when(completed, F.col("payment_intent")).alias("payment_intent"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def known(changes: DataFrame, payments: DataFrame) -> DataFrame:
    """Changes of payments that exist."""
    return changes.join(payments.select("payment_intent_id"), "payment_intent_id", "left_semi")


def latest_status(changes: DataFrame) -> DataFrame:
    """The newest change of every payment: a fold with map-side combining.

    On a stream it keeps one row of state per payment (use update mode).
    """
    newest = F.max_by(F.struct(*_COLUMNS), F.struct("ts", "event_id")).alias("_s")
    return changes.groupBy("payment_intent_id").agg(newest).select("payment_intent_id", "_s.*")


def payment_status(events: DataFrame, payments: DataFrame) -> DataFrame:
    """Status of every known payment an event speaks about, with the time it was processed.

    Events are folded before they meet the payments, so a payment with very many
    events joins as one row.
    """
    return known(latest_status(status_events(events)), payments).withColumn("webhook_processed_at", F.col("ts"))


def apply_status(payments: DataFrame, statuses: DataFrame) -> DataFrame:
    """The payments with their new status, session and intent."""
    fresh = statuses.select(
        "payment_intent_id", F.col("payment_status").alias("_status"), F.col("session_id").alias("_session"),
        F.col("payment_intent").alias("_intent"), F.col("ts").alias("webhook_processed_at"),
    )
    joined = payments.join(fresh, "payment_intent_id", "left")
    return joined.withColumns(
        {
            "payment_status": F.coalesce("_status", "payment_status"),
            "stripe_session_id": F.coalesce("_session", "stripe_session_id"),
            "stripe_payment_intent": F.coalesce("_intent", "stripe_payment_intent"),
        }
    ).drop("_status", "_session", "_intent")


def status_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that keeps the statuses as a table of deltas under ``path``.

    Each micro-batch is folded to one row per payment and written to its own ``epoch``
    folder, whether the payment is known yet or not: an event may come ahead of its
    payment. A replayed batch overwrites its folder, so the result is exactly-once; no
    state is held between batches. Read with ``current_status``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest_status(batch).write.mode("overwrite").parquet(f"{path}/deltas/epoch={epoch}")

    return status_events(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _read(spark: SparkSession, path: str, number: str) -> DataFrame:
    schema = f"{_DELTA}, {number} bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing was written yet


def _deltas(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """What a reader folds: the newest snapshot and the deltas after it, and the newest epoch."""
    snapshots, deltas = _read(spark, f"{path}/snapshots", "upto"), _read(spark, f"{path}/deltas", "epoch")
    upto = snapshots.agg(F.max("upto")).first()[0]
    newest = deltas.agg(F.max("epoch")).first()[0]
    later = deltas if upto is None else deltas.filter(F.col("epoch") > upto)
    rows = later.drop("epoch") if upto is None else later.drop("epoch").unionByName(snapshots.filter(F.col("upto") == upto).drop("upto"))
    return rows, newest if newest is not None and (upto is None or newest > upto) else None


def current_status(spark: SparkSession, path: str, payments: DataFrame | None = None) -> DataFrame:
    """One row per payment; with ``payments``, of those that exist by now. Without any batch there are none."""
    found = latest_status(_deltas(spark, path)[0])
    return (found if payments is None else known(found, payments)).withColumn("webhook_processed_at", F.col("ts"))


def compact_status(spark: SparkSession, path: str) -> None:
    """Folds all deltas so far into a snapshot, which readers use from then on.

    Deltas up to it, and older snapshots, are not read any more and may be deleted.
    """
    rows, newest = _deltas(spark, path)
    if newest is not None:
        latest_status(rows).write.mode("overwrite").parquet(f"{path}/snapshots/upto={newest}")


def status_changes(events: DataFrame, payments: DataFrame) -> DataFrame:
    """Old and new status per event, in order; the first event of a payment has no old status."""
    changes = known(status_events(events), payments)
    return previous_value(changes, "payment_intent_id", ["ts", "event_id"], "payment_status", "old_status").select(
        "payment_intent_id", "event_id", "ts", "old_status", F.col("payment_status").alias("new_status")
    )
