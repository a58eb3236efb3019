"""Sinks: tables and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one partition that a task writes, about.
_TASK_ROWS = 1 << 20


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), format: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a result; rows of one partition value may go to several files."""
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str, now: Column) -> DataFrame:
    """Target with the source rows inserted or replaced by key; write it to a new path.

    Of several source rows with one key the last by ``order`` wins. A replaced row
    keeps its ``created_at``; every written row gets ``updated_at``. One full outer
    join on the keys, after folding the source per key.
    """
    fields = [c for c in target.columns if c not in (*keys, "created_at", "updated_at")]
    newest = source.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_new"))
    old = target.select(*keys, F.struct(*fields).alias("_old"), F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"))
    merged = old.join(newest, list(keys), "full_outer")
    written = F.col("_new").isNotNull()
    return merged.select(
        *keys,
        *[F.when(written, F.col("_new")[f]).otherwise(F.col("_old")[f]).alias(f) for f in fields],
        F.coalesce("_created", now).alias("created_at"),
        F.when(written, now).otherwise(F.col("_updated")).alias("updated_at"),
    )


def upsert_in_place(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], order: str, now: Column, part: Column, name: str = "part") -> None:
    """Upserts into the Parquet table at ``path``, rewriting only the partitions that have a changed key.

    ``part`` is a column expression over ``keys`` that every row of a key agrees on, for example a range of
    the key; it is kept as the folder column ``name``. Only partitions that the source touches are read,
    merged as by ``upsert`` and written, each replaced as a whole when the job commits, so files of others
    stay as they are. The touched values come to the driver: partitions should be so large that there are few.
    The rows of a partition are brought together, in as many parts as the largest one has millions of rows,
    so files grow with the partitions and not with these times the tasks.
    Writers must not run at the same time. A table that does not exist yet is created from the source.
    """
    incoming = source.withColumn(name, part)
    touched = [row[0] for row in incoming.select(name).distinct().collect()]
    columns = [c for c in source.columns if c != order]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != order)
    stamp = source.select(now.alias("t")).schema["t"].dataType.simpleString()
    schema = f"{kinds}, created_at {stamp}, updated_at {stamp}, `{name}` {incoming.schema[name].dataType.simpleString()}"
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)
    has_null = None in touched
    held = F.col(name).isin([value for value in touched if value is not None])
    old = table.where((held | F.col(name).isNull()) if has_null else held)
    counts = old.select(name).unionByName(incoming.select(name)).groupBy(name).agg(F.count("*").alias("n"))
    parts = max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // _TASK_ROWS))
    merged = upsert(old.select(*columns, "created_at", "updated_at"), source, keys, order, now).withColumn(name, part)
    merged = merged.repartition(F.col(name), F.pmod(F.xxhash64(*keys), F.lit(parts)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
