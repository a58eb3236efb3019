"""Type tests over JSON of varying shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(column: str | Column) -> Column:
    return F.try_parse_json(F.col(column) if isinstance(column, str) else column)


def members(variant: Column, path: str = "$") -> Column:
    """An object's members as a map of variants; NULL when it is not an object."""
    return F.try_variant_get(variant, path, "map<string,variant>")


def kind(variant: Column) -> Column:
    """string, boolean, number, object, array, null; NULL when absent or unparsable."""
    return kind_of(F.schema_of_variant(variant))


def kind_of(schema: Column) -> Column:
    """The same of a schema's text."""
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def text(variant: Column) -> Column:
    """A JSON string without its quotes; anything else as JSON text."""
    return F.when(kind(variant) == "string", F.try_variant_get(variant, "$", "string")).otherwise(F.to_json(variant))
