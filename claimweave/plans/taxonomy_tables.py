"""A taxonomy derived from the part table: product = brand, benefit = type,
condition = size band. Existence flags and types follow from part keys, so that
gaps, NULL types and limits of every shape occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.plans.tables import table

# The same text runs in both engines, apart from the integer division of the band.
_LIMIT = (
    "case min(p_partkey) % 5 when 0 then null when 1 then cast(max(p_partkey) as {text}) "
    "when 2 then concat('{{\"Standard\":', cast(min(p_partkey) as {text}), ',\"Elite\":', cast(max(p_partkey) as {text}), '}}') "
    "when 3 then 'true' else '\"unlimited\"' end"
)
_PARAMETERS = "concat('{{\"min_key\":', cast(min(p_partkey) as {text}), ',\"parts\":', cast(count(*) as {text}), '}}')"
_TYPE = "case min(p_partkey) % 3 when 0 then '{prefix}exclusion' when 1 then '{prefix}eligibility' end"
_TEXT = "min(p_name)"


def _sql(name: str, text: str) -> str:
    band = f"concat('size_band_', cast(cast(floor(p_size / 10.0) as int) as {text}))"
    parameters = _PARAMETERS.format(text=text)
    limit = _LIMIT.format(text=text)
    shapes = {
        "general_conditions": f"SELECT p_brand AS product_name, {band} AS condition_name, {_TYPE.format(prefix='')} AS condition_type, "
        f"min(p_partkey) % 5 <> 0 AS condition_exist, {_TEXT} AS original_text, {parameters} AS parameters FROM part GROUP BY 1, 2",
        "benefits": f"SELECT p_brand AS product_name, p_type AS benefit_name, min(p_partkey) % 4 <> 0 AS benefit_exist, {limit} AS coverage_limit, "
        f"'{{}}' AS sub_limits, {_TEXT} AS original_text, {parameters} AS parameters FROM part GROUP BY 1, 2",
        "benefit_conditions": f"SELECT p_brand AS product_name, p_type AS benefit_name, {band} AS condition_name, {_TYPE.format(prefix='benefit_')} AS condition_type, "
        f"min(p_partkey) % 3 <> 1 OR count(*) > 2 AS condition_exist, {_TEXT} AS original_text, {parameters} AS parameters FROM part GROUP BY 1, 2, 3",
    }
    return shapes[name]


def taxonomy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("_taxonomy_part")
    return spark.sql(_sql(name, "string").replace("FROM part", "FROM _taxonomy_part"))


def taxonomy_sql() -> str:
    """CTEs ``gc``, ``b``, ``bc`` and ``products`` for the oracles."""
    return (
        f"WITH gc AS ({_sql('general_conditions', 'varchar')}), b AS ({_sql('benefits', 'varchar')}), "
        f"bc AS ({_sql('benefit_conditions', 'varchar')}), "
        "products AS (SELECT row_number() OVER (ORDER BY product_name) AS id, product_name FROM (SELECT DISTINCT p_brand AS product_name FROM part)) "
    )


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("product_name")).distinct()


def extracted_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction per part: a condition of a product with a sequence number."""
    band = F.concat(F.lit("size_band_"), F.floor(F.col("p_size") / 10).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 11 != 0, band).alias("condition_name"),
        F.when(F.col("p_partkey") % 4 == 0, "exclusion").when(F.col("p_partkey") % 4 == 1, "eligibility").when(F.col("p_partkey") % 4 == 2, "").alias("condition_type"),
        F.col("p_brand").alias("product_name"),
        (F.col("p_partkey") % 3 != 0).alias("condition_exist"),
        F.col("p_name").alias("original_text"),
        F.col("p_partkey").alias("seq"),
    )


EXTRACTED_SQL = (
    "extracted AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN concat('size_band_', cast(cast(floor(p_size / 10.0) as int) as varchar)) END AS condition_name, "
    "CASE p_partkey % 4 WHEN 0 THEN 'exclusion' WHEN 1 THEN 'eligibility' WHEN 2 THEN '' END AS condition_type, "
    "p_brand AS product_name, p_partkey % 3 <> 0 AS condition_exist, p_name AS original_text, p_partkey AS seq FROM part) "
)


def nested_layer(flat: DataFrame, layer: str) -> DataFrame:
    """Flat rows back to the nested form: a JSON record per product in a map."""
    names = {"general_conditions": ["condition_name"], "benefits": ["benefit_name"], "benefit_conditions": ["benefit_name", "condition_name"]}[layer]
    exist = "benefit_exist" if layer == "benefits" else "condition_exist"
    limit = F.concat(F.lit(',"coverage_limit":'), F.col("coverage_limit")) if layer == "benefits" else F.lit("")
    parameters = F.concat(F.expr("left(parameters, length(parameters) - 1)"), F.coalesce(limit, F.lit("")), F.lit("}"))
    record = F.concat(
        F.lit(f'{{"{exist}":'), F.col(exist).cast("string"), F.lit(',"original_text":"'), F.col("original_text"),
        F.lit('","parameters":'), parameters, F.lit("}"),
    )
    # One entry per product of the dimension.
    kinds = [] if layer == "benefits" else [F.min("condition_type").alias("condition_type")]
    nested = flat.withColumn("_r", record).groupBy(*names).agg(
        *kinds, F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_name", "_r")))).alias("products")
    )
    return nested.withColumnRenamed("condition_name", "condition") if "condition_name" in names else nested
