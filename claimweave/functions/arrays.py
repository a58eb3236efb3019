"""Small array helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def names_where(conditions: Mapping[str, Column]) -> Column:
    """The names whose condition holds, in order.

    ``array_except`` stays inside generated code, where ``array_compact`` would
    fall back to interpreting all conditions.
    """
    named = F.array(*[F.when(condition, F.lit(name)) for name, condition in conditions.items()])
    return F.array_except(named, F.array(F.lit(None).cast("string")))
