"""Containment of JSON values, for many patterns at once.

Values and patterns are flattened to their nodes, level by level and no deeper than the deepest
pattern. A value's node can only match a pattern's node on the same path (array positions do not count)
with the same scalar. From the deepest level up, a container matches if each child of the
pattern's container is matched by one of its own children: a division, as joins and counts.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import variants
from claimweave.session import cut_lineage

_CONTAINERS = ("object", "array")
# Nodes of patterns that are shipped to the rows.
MAX_SHIPPED = 10_000


def _scalar(value: Column, kind: Column) -> Column:
    """A scalar's text, numbers by value: 1 and 1.0 are equal."""
    number = F.coalesce(F.try_variant_get(value, "$", "decimal(38,9)").cast("string"), F.try_variant_get(value, "$", "double").cast("string"))
    return F.when(kind == "number", number).when(~kind.isin(*_CONTAINERS), F.to_json(value))


def _described(df: DataFrame) -> DataFrame:
    """``row, path, parent, shape, value`` with kind and scalar."""
    kind = variants.kind(F.col("value"))
    return df.withColumn("kind", kind).withColumn("scalar", _scalar(F.col("value"), F.col("kind")))


def _shipped(nodes: DataFrame) -> DataFrame:
    """Few nodes visit the rows: most rows have the same shape, and would meet it in one task."""
    return F.broadcast(nodes) if nodes.limit(MAX_SHIPPED + 1).count() <= MAX_SHIPPED else nodes


def _like(own: DataFrame, shape: str, kind: str, scalar: str) -> Column:
    return (own["shape"] == F.col(shape)) & (own["kind"] == F.col(kind)) & own["scalar"].eqNullSafe(F.col(scalar))


def _levels(df: DataFrame, wanted: list[DataFrame] | None = None) -> list[DataFrame]:
    """Nodes by depth of the values ``row, value``, as far as there are any; with the levels of ``wanted``, only nodes like one of theirs.

    What lies below a node unlike all is not needed.
    """
    spark = df.sparkSession
    level = _described(df.select("row", F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("$").alias("shape"), "value").where("value is not null"))
    found = []
    while True:
        if wanted is not None:
            kinds = wanted[len(found)].select(F.col("shape").alias("_shape"), F.col("kind").alias("_kind"), F.col("scalar").alias("_scalar")).distinct()
            level = level.join(_shipped(kinds), _like(level, "_shape", "_kind", "_scalar"), "left_semi")
        level = cut_lineage(level)
        found.append(level)
        if (wanted is not None and len(found) == len(wanted)) or level.where(F.col("kind").isin(*_CONTAINERS)).isEmpty():
            return found
        inner = level.where(F.col("kind").isin(*_CONTAINERS)).select("row", F.col("path").alias("parent"), F.col("shape").alias("above"), F.col("value").alias("outer_"))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer_").outer()))
        # Keys are quoted, so a key that looks like a path is none.
        step = lambda of, array: F.concat(F.col(of), F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.to_json(F.struct(F.col("key").alias("k"))))).otherwise(array))
        at = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        level = _described(parts.select("row", step("parent", at).alias("path"), "parent", step("above", F.lit("[]")).alias("shape"), "value"))


def contains_any(df: DataFrame, patterns: DataFrame, id: str, column: str, pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """``id, pattern_id`` of every row whose JSON ``column`` contains the pattern.

    An object contains another if it has all its keys, each with a value that contains the other's; an
    array contains another if each element of the other is contained in one of its own,
    whatever order and number; scalars contain their equals. As the one exception, an array at the top contains a
    scalar that is one of its elements. Null or invalid JSON contains nothing and is contained nowhere;
    ``id`` is unique. The patterns should be few and small beside the rows: up to ``MAX_SHIPPED`` nodes of a level visit every
    task, beyond that the join is left to Spark.
    """
    asked = patterns.select(F.col(pattern_id).alias("row"), variants.parse(pattern).alias("value")).where("value is not null")
    lone = asked.where(~variants.kind(F.col("value")).isin(*_CONTAINERS))
    # A lone scalar is also looked for as the element of an array.
    tried = asked.select(F.struct("row", F.lit(0).alias("form")).alias("row"), "value").unionByName(
        lone.select(F.struct("row", F.lit(1).alias("form")).alias("row"), F.parse_json(F.concat(F.lit("["), F.to_json("value"), F.lit("]"))).alias("value"))
    )
    wanted = _levels(tried)
    held = _levels(df.select(F.col(id).alias("row"), variants.parse(column).alias("value")), wanted)
    matched = None
    for depth in range(min(len(held), len(wanted)) - 1, -1, -1):
        nodes = wanted[depth].select(F.col("row").alias("_pattern"), F.col("path").alias("_node"), F.col("parent").alias("_above"), F.col("shape").alias("_shape"), F.col("kind").alias("_kind"), F.col("scalar").alias("_scalar"))
        if depth + 1 < len(wanted):
            children = wanted[depth + 1].groupBy(F.col("row").alias("_pattern"), F.col("parent").alias("_node")).agg(F.count("*").alias("_children"))
            nodes = nodes.join(children, ["_pattern", "_node"], "left")
        else:
            nodes = nodes.withColumn("_children", F.lit(None).cast("bigint"))
        own = held[depth]
        candidates = own.join(_shipped(nodes), _like(own, "_shape", "_kind", "_scalar")).select("row", "path", "parent", "_pattern", "_node", "_above", "_children")
        whole = candidates.where("_children is null")
        if matched is not None:
            met = matched.groupBy("row", F.col("parent").alias("path"), "_pattern", F.col("_above").alias("_node")).agg(F.count_distinct("_node").alias("_met"))
            divided = candidates.where("_children is not null").join(met, ["row", "path", "_pattern", "_node"]).where("_met = _children")
            whole = whole.unionByName(divided.select(candidates.columns))
        matched = whole
    empty = df.select(F.col(id)).limit(0).join(patterns.select(F.col(pattern_id)).limit(0))
    return empty if matched is None else matched.select(F.col("row").alias(id), F.col("_pattern.row").alias(pattern_id)).distinct()
