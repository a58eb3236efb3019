"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from claimweave.session import scratch_path

# White space is the six ASCII characters; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Rows without an id sort behind all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 without text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) drawn by the seed from the first part that is not null.

    It has 52 bits, so a double holds it without rounding, and any engine with md5 draws the same.
    """
    text = F.coalesce(*[part.cast("string") for part in parts], F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pinned(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again.

    Like a checkpoint it cuts the lineage and outlives lost executors, but the files are compressed and columnar.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(docs: DataFrame, function: Callable[[list[str | None]], list[Sequence]], fields: dict[str, pa.DataType], keep: Sequence[str] | None = None) -> DataFrame:
    """Adds columns computed from the texts of each Arrow batch.

    The result has the struct ``row`` with the columns in ``keep`` (all by default), which pass
    through untouched, and the new ``fields``. Nothing is shuffled.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text"))
    names, kinds = ["row", *fields], list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = function(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    added = [T.StructField(name, from_arrow_type(kind)) for name, kind in fields.items()]
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), *added]))
