"""Session defaults, the shared scratch folder and the result normaliser."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app_name: str = "claimweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    ``master`` stays unset on a cluster, so that spark-submit decides.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one named by ``spark.checkpoint.dir`` (or already set on the
    context). Only a local session without one gets a temporary folder; a
    cluster session without one is an error, because executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/claimweave/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """Evens out a scan that has fewer tasks than the session has cores.

    A table of a few large row groups would run costly row functions in a few
    tasks. Scans with enough tasks, so all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_within_threshold(df: DataFrame, *scans: DataFrame) -> DataFrame:
    """Marks a join of lookup tables for broadcast when all its scans together stay
    within the session's broadcast threshold.

    Spark multiplies the sizes of joined tables when it estimates their join, so
    it would not ship even a few small tables joined beforehand. Each row of such a
    join comes from one row of its largest table, so the sum is the fair measure.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = sum(int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for scan in scans)
    return F.broadcast(df) if size <= limit else df


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Engine-neutral column types: integers to bigint, decimals and floats to
    rounded doubles, dates and timestamps to ISO strings."""

    def convert(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return column.alias(field.name)

    return df.select([convert(field) for field in df.schema.fields])
