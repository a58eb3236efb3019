"""Applying a caller's model to every row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimweave.operators.calls import TokenBucket, in_order


def annotate(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], list[str]]],
    batch: int = 50,
    retries: int = 3,
    wait: float = 0.0,
    workers: int = 1,
    per_second: float | None = None,
) -> DataFrame:
    """Adds ``status``, ``response`` and ``error`` from a caller's function.

    ``load`` returns the function and runs once per task; it gets a frame of up to
    ``batch`` rows and returns one text per row. A failing batch is retried row by
    row with a growing pause, and so is one that gives another number of texts; what
    still fails becomes an error row.

    A task makes up to ``workers`` calls at once (the function must then be safe to call from several
    threads) and starts at most ``per_second`` of them, retries included; with n tasks at
    a time the cluster makes n times as many. Rows keep their order.
    """
    added = [T.StructField(c, T.StringType()) for c in ("status", "response", "error")]
    schema = T.StructType(df.schema.fields + added)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, bucket = load(), TokenBucket(per_second, workers)

        def call(rows: pd.DataFrame) -> list[str]:
            bucket.take()
            return list(model(rows))

        def single(row: pd.DataFrame) -> tuple[str, str | None, str | None]:
            problem = None
            for attempt in range(retries):
                try:
                    texts = call(row)
                    if len(texts) != 1:
                        raise ValueError(f"{len(texts)} answers to one row")
                    return "success", texts[0], None
                except Exception as error:
                    problem = str(error)
                    time.sleep(wait * 2**attempt)
            return "error", None, problem

        def answered(part: pd.DataFrame) -> pd.DataFrame:
            try:
                texts = call(part)
                if len(texts) != len(part):
                    raise ValueError(f"{len(texts)} answers to {len(part)} rows")
                outcomes = [("success", text, None) for text in texts]
            except Exception:  # find the rows that fail
                outcomes = [single(part.iloc[i : i + 1]) for i in range(len(part))]
            return pd.concat([part, pd.DataFrame(outcomes, columns=["status", "response", "error"], index=part.index, dtype=object)], axis=1)

        parts = (frame.iloc[start : start + batch] for frame in frames for start in range(0, len(frame), batch))
        yield from in_order(answered, parts, workers)

    return df.mapInPandas(run, schema)
