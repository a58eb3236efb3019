"""Taxonomy operators over the part-derived taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import containment, postings
from claimweave.operators import taxonomy as ops
from claimweave.plans.registry import Registry
from claimweave.plans.tables import table
from claimweave.plans.taxonomy_tables import (
    EXTRACTED_SQL,
    extracted_conditions,
    nested_layer,
    product_names,
    taxonomy_sql,
    taxonomy_table,
)

REGISTRY = Registry.empty()
_WITH = taxonomy_sql()
_WITH_EXTRACTED = f"WITH {EXTRACTED_SQL} "


@REGISTRY.add("c01_unique_keys", _WITH_EXTRACTED + "SELECT DISTINCT condition_name FROM extracted WHERE condition_name IS NOT NULL AND condition_name <> ''")
def unique_keys(spark, sf_dir):
    return ops.unique_keys(extracted_conditions(spark, sf_dir), ["condition_name"])


@REGISTRY.add("c01_unique_pairs", _WITH + "SELECT DISTINCT benefit_name, condition_name FROM bc")
def unique_pairs(spark, sf_dir):
    return ops.unique_keys(taxonomy_table(spark, sf_dir, "benefit_conditions"), ["benefit_name", "condition_name"])


def judged(spark, sf_dir):
    """Two validations per order; orders still open count as failed extractions."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"),
        F.col("o_orderpriority").alias("product_name"),
        F.col("o_orderkey").alias("text_index"),
        F.array(
            F.struct(F.lit(0).alias("item_index"), (F.col("o_custkey") % 2 == 0).alias("approve"), F.col("o_orderpriority").alias("final_value")),
            F.struct(
                F.lit(1).alias("item_index"), (F.col("o_custkey") % 3 == 0).alias("approve"),
                F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).otherwise("").alias("final_value"),
            ),
        ).alias("validations"),
    )


@REGISTRY.add(
    "c02_approved_values",
    "SELECT o_orderpriority AS product_name, o_orderkey AS text_index, CAST(0 AS BIGINT) AS item_index, o_orderpriority AS final_value FROM orders "
    "WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderkey, 1, o_orderstatus FROM orders "
    "WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_orderkey % 5 <> 0",
)
def approved_values(spark, sf_dir):
    return ops.approved_values(judged(spark, sf_dir))[0]


@REGISTRY.add(
    "c02_failed_extractions",
    "SELECT 'failed' AS status, o_orderpriority AS product_name, o_orderkey AS text_index FROM orders WHERE o_orderstatus <> 'F'",
)
def failed_extractions(spark, sf_dir):
    return ops.approved_values(judged(spark, sf_dir))[1]


@REGISTRY.add(
    "c02_judgement_counts",
    "SELECT count(*) AS total_chunks, count(*) FILTER (WHERE s) AS successful, count(*) FILTER (WHERE s AND (a OR b)) AS approved_chunks, "
    "CAST(coalesce(sum(CASE WHEN s THEN CAST(a AS INT) + CAST(b AS INT) END), 0) AS BIGINT) AS items, count(*) FILTER (WHERE NOT s) AS failures FROM "
    "(SELECT o_orderstatus = 'F' AS s, o_custkey % 2 = 0 AS a, o_custkey % 3 = 0 AND o_orderkey % 5 <> 0 AS b FROM orders)",
)
def judgement_counts(spark, sf_dir):
    return ops.approved_values(judged(spark, sf_dir))[2]


@REGISTRY.add(
    "c03_complete_grid",
    _WITH_EXTRACTED
    + ", keys AS (SELECT DISTINCT condition_name FROM extracted WHERE condition_name IS NOT NULL), brands AS (SELECT DISTINCT product_name FROM extracted), "
    "latest AS (SELECT condition_name, product_name, arg_max(condition_exist, seq) AS e, arg_max(original_text, seq) AS t FROM extracted GROUP BY 1, 2), "
    "kinds AS (SELECT condition_name, arg_max(condition_type, seq) AS condition_type FROM extracted WHERE condition_type <> '' GROUP BY 1) "
    "SELECT k.condition_name, kinds.condition_type, b.product_name, coalesce(e, false) AS condition_exist, coalesce(t, '') AS original_text FROM keys k CROSS JOIN brands b "
    "LEFT JOIN latest l ON l.condition_name = k.condition_name AND l.product_name = b.product_name LEFT JOIN kinds ON kinds.condition_name = k.condition_name",
)
def complete_grid(spark, sf_dir):
    values = extracted_conditions(spark, sf_dir)
    return ops.complete_grid(
        values,
        ops.unique_keys(values, ["condition_name"]),
        product_names(spark, sf_dir),
        ["condition_name"],
        {"condition_exist": F.lit(False), "original_text": F.lit("")},
        last_filled=["condition_type"],
    )


def _layers(spark, sf_dir):
    return {
        "layer_1_general_conditions": nested_layer(taxonomy_table(spark, sf_dir, "general_conditions"), "general_conditions"),
        "layer_2_benefits": nested_layer(taxonomy_table(spark, sf_dir, "benefits"), "benefits"),
        "layer_3_benefit_specific_conditions": nested_layer(taxonomy_table(spark, sf_dir, "benefit_conditions"), "benefit_conditions"),
    }


@REGISTRY.add("c04_assembled_products", "SELECT DISTINCT p_brand AS product_name FROM part")
def assembled_products(spark, sf_dir):
    return ops.assemble(_layers(spark, sf_dir))[0]


@REGISTRY.add(
    "c04_assembled_counts",
    _WITH
    + ", counts AS (SELECT 'layer_1_general_conditions' AS layer, count(DISTINCT condition_name) AS items FROM gc "
    "UNION ALL SELECT 'layer_2_benefits', count(DISTINCT benefit_name) FROM b UNION ALL "
    "SELECT 'layer_3_benefit_specific_conditions', count(DISTINCT benefit_name || ':' || condition_name) FROM bc) "
    "SELECT * FROM counts UNION ALL SELECT 'total', CAST(sum(items) AS BIGINT) FROM counts",
)
def assembled_counts(spark, sf_dir):
    return ops.assemble(_layers(spark, sf_dir))[1]


# Items with every kind of defect, as text both engines read alike.
_EXIST = "case when p_partkey % 5 = 0 then '\"yes\"' else 'true' end"
_NAME = "case when p_partkey % 7 = 0 then '3' else concat('\"', p_type, '\"') end"
_ITEMS = {
    "general_conditions": "case when p_partkey % 13 = 0 then '[]' else concat('{\"condition\":', " + _NAME + ", "
    "case p_partkey % 4 when 0 then ',\"condition_type\":\"exclusion\"' when 1 then ',\"condition_type\":\"eligibility\"' when 2 then ',\"condition_type\":\"other\"' else '' end, "
    "',\"products\":{\"', p_brand, '\":{\"condition_exist\":', " + _EXIST + ", case when p_partkey % 6 = 0 then '' else ',\"original_text\":\"t\"' end, "
    "',\"parameters\":', case when p_partkey % 9 = 0 then '[]' else '{}' end, '}}}') end",
    "benefits": "concat('{\"benefit_name\":', " + _NAME + ", case when p_partkey % 11 = 0 then '' when p_partkey % 11 = 1 then ',\"products\":[]' else concat(',\"products\":{\"', p_brand, "
    "'\":{\"condition_exist\":', " + _EXIST + ", ',\"parameters\":{', case when p_partkey % 3 = 0 then '\"coverage_limit\":1' else '' end, '}}}') end, '}')",
    "benefit_specific_conditions": "concat('{\"benefit_name\":\"b\",\"condition\":', " + _NAME + ", ',\"condition_type\":\"', "
    "case when p_partkey % 2 = 0 then 'benefit_exclusion' else 'exclusion' end, '\",\"products\":{\"', p_brand, '\":{\"condition_exist\":', " + _EXIST + ", ',\"original_text\":\"\",\"parameters\":{}}}}')",
}
_LABEL = "'product ' || p_brand || ': "
_EXIST_ERROR = f"CASE WHEN p_partkey % 5 = 0 THEN {_LABEL}condition_exist not boolean' END"
_ERRORS = {
    "general_conditions": "CASE WHEN p_partkey % 13 = 0 THEN 'item: not an object' ELSE concat_ws('; ', CASE WHEN p_partkey % 4 = 3 THEN 'missing: condition_type' END, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'condition: not a string' END, CASE WHEN p_partkey % 4 = 2 THEN 'condition_type: must be one of eligibility, exclusion' END, "
    f"CASE WHEN p_partkey % 6 = 0 THEN {_LABEL}missing original_text' END, {_EXIST_ERROR}, CASE WHEN p_partkey % 9 = 0 THEN {_LABEL}parameters not an object' END) END",
    "benefits": "concat_ws('; ', CASE WHEN p_partkey % 11 = 0 THEN 'missing: products' END, CASE WHEN p_partkey % 7 = 0 THEN 'benefit_name: not a string' END, "
    f"CASE WHEN p_partkey % 11 = 1 THEN 'products: not an object' END, CASE WHEN p_partkey % 11 > 1 THEN {_EXIST_ERROR} END)",
    "benefit_specific_conditions": "concat_ws('; ', CASE WHEN p_partkey % 7 = 0 THEN 'condition: not a string' END, "
    f"CASE WHEN p_partkey % 2 = 1 THEN 'condition_type: must be one of benefit_eligibility, benefit_exclusion' END, {_EXIST_ERROR})",
}
_WARNINGS = {"benefits": f"CASE WHEN p_partkey % 11 > 1 AND p_partkey % 3 <> 0 THEN {_LABEL}missing coverage_limit' ELSE '' END"}


def _validation(layer: str):
    @REGISTRY.add(
        f"c05_validate_{layer}",
        f"SELECT p_partkey, errors, warnings, errors = '' AS is_valid FROM (SELECT p_partkey, {_ERRORS[layer]} AS errors, {_WARNINGS.get(layer, chr(39) * 2)} AS warnings FROM part)",
    )
    def validate(spark, sf_dir):
        items = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ITEMS[layer]).alias("item"))
        checked = ops.validate_items(items, layer)
        return checked.select("p_partkey", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


for _layer in _ITEMS:
    _validation(_layer)


@REGISTRY.add(
    "c06_normalize_exist",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN p_size > 25 ELSE p_partkey % 2 = 0 END AS benefit_exist FROM part",
)
def normalize_exist(spark, sf_dir):
    records = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 1, F.col("p_size") > 25).alias("benefit_exist"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 2 == 0).alias("condition_exist"),
    )
    return ops.normalize_exist(records).drop("condition_exist")


_LIMITS = (
    "CASE WHEN coverage_limit IS NULL THEN NULL WHEN coverage_limit = 'true' THEN 'boolean' WHEN coverage_limit LIKE '{%' THEN 'plan_tiered' "
    "WHEN coverage_limit LIKE '\"%' THEN 'other' ELSE 'numeric' END"
)


@REGISTRY.add(
    "c07_normalize_limit",
    _WITH + f"SELECT product_name, benefit_name, {_LIMITS} AS limit_type, "
    "CASE WHEN coverage_limit LIKE '{%' THEN concat('{\"Elite\":', regexp_extract(coverage_limit, '\"Elite\":([0-9]+)', 1), ',\"Standard\":', regexp_extract(coverage_limit, '\"Standard\":([0-9]+)', 1), '}') "
    "ELSE trim(coverage_limit, '\"') END AS limit_value FROM b",
)
def normalize_limit(spark, sf_dir):
    limits = taxonomy_table(spark, sf_dir, "benefits").withColumn("_l", ops.normalize_limit("coverage_limit"))
    return limits.select("product_name", "benefit_name", F.col("_l.type").alias("limit_type"), F.col("_l.value").alias("limit_value"))


def _products(spark, sf_dir):
    return ops.product_ids(product_names(spark, sf_dir))


@REGISTRY.add(
    "c08_flatten_conditions",
    _WITH
    + ", kinds AS (SELECT condition_name, min(condition_type) AS condition_type FROM gc GROUP BY 1) SELECT gc.condition_name, kinds.condition_type, gc.product_name, condition_exist, original_text, parameters, id AS product_id "
    "FROM gc JOIN kinds USING (condition_name) JOIN products USING (product_name) WHERE condition_exist",
)
def flatten_conditions(spark, sf_dir):
    layer = _layers(spark, sf_dir)["layer_1_general_conditions"]
    return ops.flatten_layer(layer, "general_conditions", _products(spark, sf_dir))


@REGISTRY.add(
    "c08_flatten_benefits",
    _WITH + f"SELECT benefit_name, product_name, original_text, {_LIMITS} AS limit_type, sub_limits, id AS product_id FROM b JOIN products USING (product_name) WHERE benefit_exist",
)
def flatten_benefits(spark, sf_dir):
    flat = ops.flatten_layer(_layers(spark, sf_dir)["layer_2_benefits"], "benefits", _products(spark, sf_dir))
    return flat.select("benefit_name", "product_name", "original_text", F.col("coverage_limit.type").alias("limit_type"), "sub_limits", "product_id")


@REGISTRY.add(
    "c08_flatten_benefit_conditions",
    _WITH + "SELECT benefit_name, condition_name, product_name, original_text, parameters, id AS product_id FROM bc JOIN products USING (product_name) WHERE condition_exist",
)
def flatten_benefit_conditions(spark, sf_dir):
    layer = _layers(spark, sf_dir)["layer_3_benefit_specific_conditions"]
    flat = ops.flatten_layer(layer, "benefit_specific_conditions", _products(spark, sf_dir))
    return flat.drop("condition_exist", "condition_type")


@REGISTRY.add("c09_product_ids", _WITH + "SELECT id, product_name FROM products")
def product_ids(spark, sf_dir):
    return _products(spark, sf_dir)


_TITLE = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_SPELLED = "'Parameters: min_key: ' || regexp_extract(parameters, '\"min_key\":([0-9]+)', 1) || '; parts: ' || regexp_extract(parameters, '\"parts\":([0-9]+)', 1)"


def _grouped(pattern: str) -> str:
    return f"format('{{:,}}', CAST(regexp_extract(coverage_limit, '{pattern}', 1) AS BIGINT))"


@REGISTRY.add(
    "c10_describe_benefits",
    _WITH + "SELECT product_name, benefit_name, concat_ws(chr(10), 'Benefit: ' || " + _TITLE.format("benefit_name") + ", CASE WHEN coverage_limit IS NULL THEN NULL "
    "WHEN coverage_limit = 'true' THEN 'Coverage limit: $1' WHEN coverage_limit LIKE '\"%' THEN trim(coverage_limit, '\"') "
    f"WHEN coverage_limit LIKE '{{%' THEN 'Coverage limits: Standard: $' || {_grouped('Standard.:([0-9]+)')} || '; Elite: $' || {_grouped('Elite.:([0-9]+)')} "
    f"ELSE 'Coverage limit: $' || {_grouped('([0-9]+)')} END, {_SPELLED}) AS description FROM b",
)
def describe_benefits(spark, sf_dir):
    rows = taxonomy_table(spark, sf_dir, "benefits").withColumnRenamed("coverage_limit", "raw_limit")
    return ops.describe_item(rows, "benefits").select("product_name", "benefit_name", "description")


@REGISTRY.add(
    "c10_describe_benefit_conditions",
    _WITH + "SELECT product_name, benefit_name, condition_name, concat_ws(chr(10), 'Benefit: ' || " + _TITLE.format("benefit_name")
    + ", 'Condition: Size Band ' || right(condition_name, 1), 'Type: ' || condition_type, " + _SPELLED + ") AS description FROM bc",
)
def describe_benefit_conditions(spark, sf_dir):
    rows = taxonomy_table(spark, sf_dir, "benefit_conditions")
    return ops.describe_item(rows, "benefit_specific_conditions").select("product_name", "benefit_name", "condition_name", "description")


@REGISTRY.add(
    "c10_describe_nested",
    "SELECT p_partkey, concat_ws(chr(10), 'Benefit: Cover', 'Coverage limits: Basic: $' || format('{:,}', p_partkey) || '; more: {top: {gold: none}}', "
    "'Sub-limits: a: {  b: {    c: {      d: {        e: $100;         f: {          g: $1}}}}}', "
    "'Parameters: l1: {l2: {l3: {l4: {l5: {l6: {l7: ' || p_partkey || '; on: True}}; list: [1, a, False, None]}}}}; quoted {: {x: }}') AS description FROM part",
)
def describe_nested(spark, sf_dir):
    """Seven levels, lists, sub-limits in objects, and braces inside keys and texts."""
    key = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("cover").alias("benefit_name"), F.concat(F.lit('{"Basic":'), key, F.lit(',"more":{"top":{"gold":"none"}}}')).alias("raw_limit"),
        F.lit('{"a":{"b":{"c":{"d":{"e":100,"f":{"g":true}}}}}}').alias("sub_limits"),
        F.concat(F.lit('{"l1":{"l2":{"l3":{"l4":{"l5":{"l6":{"l7":'), key, F.lit(',"on":true}},"list":[1,"a",false,null]}}}},"quoted {":{"x":"}"}}')).alias("parameters"),
    )
    return ops.describe_item(rows, "benefits").select("p_partkey", "description")


@REGISTRY.add(
    "c11_comparison_view",
    _WITH + "SELECT 'benefit' AS item_type, benefit_name AS item_name, product_name, benefit_exist AS exists, coverage_limit, sub_limits, parameters FROM b WHERE benefit_exist "
    "UNION ALL SELECT 'condition', condition_name, product_name, condition_exist, NULL, NULL, parameters FROM gc WHERE condition_exist",
)
def comparison_view(spark, sf_dir):
    return ops.comparison_view(taxonomy_table(spark, sf_dir, "benefits"), taxonomy_table(spark, sf_dir, "general_conditions"))


@REGISTRY.add(
    "c12_eligibility_view",
    _WITH + "SELECT product_name, condition_name, condition_type, parameters, original_text, CASE condition_type WHEN 'exclusion' THEN 'excluded' WHEN 'eligibility' THEN 'eligible' ELSE 'unknown' END AS eligibility_status "
    "FROM gc WHERE condition_exist UNION ALL SELECT product_name, benefit_name || ': ' || condition_name, condition_type, parameters, original_text, "
    "CASE condition_type WHEN 'benefit_exclusion' THEN 'excluded' WHEN 'benefit_eligibility' THEN 'eligible' ELSE 'unknown' END FROM bc WHERE condition_exist",
)
def eligibility_view(spark, sf_dir):
    return ops.eligibility_view(taxonomy_table(spark, sf_dir, "general_conditions"), taxonomy_table(spark, sf_dir, "benefit_conditions"))


@REGISTRY.add(
    "c13_scenario_view",
    _WITH + ", kept AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY product_name, benefit_name) / 2.0) AS BIGINT) AS parts FROM bc WHERE condition_exist), "
    "placed AS (SELECT *, CAST('0x' || substr(md5(condition_name), 1, 8) AS BIGINT) % parts AS part FROM kept) "
    "SELECT b.product_name, b.benefit_name, b.coverage_limit, b.original_text AS benefit_text, coalesce(part, 0) AS part, string_agg(p.condition_name || '=' || coalesce(p.condition_type, '?'), ',' ORDER BY p.condition_name) AS related_conditions "
    "FROM b LEFT JOIN placed p ON b.product_name = p.product_name AND b.benefit_name = p.benefit_name WHERE b.benefit_exist GROUP BY ALL",
)
def scenario_view(spark, sf_dir):
    view = ops.scenario_view(taxonomy_table(spark, sf_dir, "benefits"), taxonomy_table(spark, sf_dir, "benefit_conditions"), max_conditions=2)
    flat = F.array_join(F.transform("related_conditions", lambda c: F.concat_ws("=", c["condition_name"], F.coalesce(c["condition_type"], F.lit("?")))), ",")
    return view.select("product_name", "benefit_name", "coverage_limit", "benefit_text", "part", flat.alias("related_conditions"))


def _count_kind(table_name: str, kind: str, name: str) -> str:
    return f"count(DISTINCT CASE WHEN {table_name}.condition_type = '{kind}' THEN {table_name}.condition_name END) AS {name}"


@REGISTRY.add(
    "c14_taxonomy_stats",
    _WITH + "SELECT p.product_name, count(DISTINCT gc.condition_name) AS total_general_conditions, "
    + ", ".join(
        [_count_kind("gc", "exclusion", "exclusion_count"), _count_kind("gc", "eligibility", "eligibility_count"), "count(DISTINCT b.benefit_name) AS total_benefits",
         "count(DISTINCT bc.condition_name) AS total_benefit_conditions", _count_kind("bc", "benefit_exclusion", "benefit_exclusion_count"), _count_kind("bc", "benefit_eligibility", "benefit_eligibility_count")]
    )
    + " FROM products p LEFT JOIN gc ON p.product_name = gc.product_name AND gc.condition_exist LEFT JOIN b ON p.product_name = b.product_name AND b.benefit_exist "
    "LEFT JOIN bc ON p.product_name = bc.product_name AND bc.condition_exist GROUP BY p.product_name",
)
def taxonomy_stats(spark, sf_dir):
    """Counted by name; ids are not needed to count."""
    named = lambda df: df.withColumn("product_id", F.col("product_name"))
    children = [named(taxonomy_table(spark, sf_dir, name)) for name in ("general_conditions", "benefits", "benefit_conditions")]
    return ops.taxonomy_stats(product_names(spark, sf_dir).withColumn("id", F.col("product_name")), *children)


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@REGISTRY.add(
    "c15_comparison_matrix",
    _WITH + "SELECT item_type, item_name, "
    + ", ".join(f"max(CASE WHEN product_name = '{b}' THEN v END) AS \"{b}\"" for b in BRANDS)
    + " FROM (SELECT 'benefit' AS item_type, benefit_name AS item_name, product_name, coverage_limit AS v FROM b WHERE benefit_exist "
    "UNION ALL SELECT 'condition', condition_name, product_name, NULL FROM gc WHERE condition_exist) GROUP BY 1, 2",
)
def comparison_matrix(spark, sf_dir):
    """The products come from the data; the other engine's list is written out."""
    return ops.comparison_matrix(comparison_view(spark, sf_dir))


@REGISTRY.add("c16_contains", "SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def contains(spark, sf_dir):
    return ops.contains(table(spark, sf_dir, "events").select("event_id", "props"), "props", "$.k", 42)


_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\pL\\pN]+'), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)


@REGISTRY.add(
    "c17_fuzzy_names",
    f"SELECT * FROM (SELECT p_name, round(CAST(len(list_intersect(g, q)) AS DOUBLE) / len(list_distinct(list_concat(g, q))), 6) AS similarity FROM "
    f"(SELECT p_name, {_GRAMS.format('p_name')} AS g, {_GRAMS.format(chr(39) + 'cold rings' + chr(39))} AS q FROM (SELECT DISTINCT p_name FROM part))) WHERE similarity >= 0.3",
)
def fuzzy_names(spark, sf_dir):
    return ops.fuzzy_names(table(spark, sf_dir, "part"), "p_name", "cold rings")


# Nested JSON from events; the same text runs in both engines.
_DETAILS = (
    "concat('{{\"user\":{{\"id\":', cast(user_id as {text}), ',\"did\":\"', event_type, '\"}},\"tags\":[\"t', cast(event_id % 7 as {text}), '\",\"t', cast(event_id % 5 as {text}), '\",', cast(event_id % 3 as {text}), "
    "'],\"items\":[{{\"sku\":', cast(event_id % 4 as {text}), ',\"n\":', cast(event_id % 3 as {text}), '}},{{\"sku\":', cast(event_id % 6 as {text}), ',\"n\":1.0,\"more\":[[', cast(event_id % 2 as {text}), ',null]]}}]}}')"
)
_PATTERNS = {
    "user": '{"user":{"did":"click"}}',
    "tags": '{"tags":["t4",2,"t4"]}',
    "one_item": '{"items":[{"n":2.0,"sku":3}]}',
    "two_items": '{"items":[{"sku":3},{"sku":1}],"user":{}}',
    "deep": '{"items":[{"more":[[1],[]]}]}',
    "list": '["t4"]',
    "wrong_kind": '{"tags":{}}',
    "all": "{}",
}
_WHERE = {
    "user": "event_type = 'click'",
    "tags": "(event_id % 7 = 4 OR event_id % 5 = 4) AND event_id % 3 = 2",
    "one_item": "event_id % 4 = 3 AND event_id % 3 = 2",
    "two_items": "(event_id % 4 = 3 OR event_id % 6 = 3) AND (event_id % 4 = 1 OR event_id % 6 = 1)",
    "deep": "event_id % 2 = 1",
    "all": "true",
}


@REGISTRY.add("c16_contains_any", " UNION ALL ".join(f"SELECT event_id, '{name}' AS pattern_id FROM events WHERE {where}" for name, where in _WHERE.items()))
def contains_any(spark, sf_dir):
    """Objects, arrays and what is inside them, several patterns at once; two of them match nothing."""
    details = table(spark, sf_dir, "events").select("event_id", F.expr(_DETAILS.format(text="string")).alias("details"))
    patterns = spark.createDataFrame(list(_PATTERNS.items()), "pattern_id string, pattern string")
    return containment.contains_any(details, patterns, "event_id", "details")


_HEADLINES = (
    "heads AS (SELECT DISTINCT regexp_extract(text, '^[^.\n]*', 0) AS n FROM documents WHERE text IS NOT NULL), titles AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)', 1) AS n FROM pages WHERE html IS NOT NULL)"
)


@REGISTRY.add(
    "c17_fuzzy_join",
    f"WITH {_HEADLINES}, a AS (SELECT n, {_GRAMS.format('n')} AS g FROM titles), b AS (SELECT n, {_GRAMS.format('n')} AS g FROM heads) "
    "SELECT * FROM (SELECT a.n AS left_name, b.n AS right_name, round(CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM a, b WHERE len(a.g) > 0 AND len(b.g) > 0) WHERE similarity >= 0.4",
)
def fuzzy_join(spark, sf_dir):
    """Page titles and the first sentences of documents that resemble each other."""
    titles = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    heads = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"^[^.\n]*", 0).alias("head"))
    return postings.fuzzy_join(titles, heads, "title", "head", ops.trigrams, 0.4)


def turn_chunks(spark, sf_dir):
    """Conversation turns as a chunk table; user turns carry a vector."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("product_name"),
        F.col("turn").alias("chunk_index"),
        "text",
        F.length("text").alias("char_count"),
        F.when(F.col("role") == "user", F.array(F.length("text").cast("float"))).alias("original_embedding"),
    )


@REGISTRY.add(
    "c18_chunk_stats",
    "SELECT count(*) AS total_chunks, count(DISTINCT conv_id) AS total_products, CAST(sum(length(text)) AS BIGINT) AS total_characters, "
    "count(*) FILTER (WHERE role = 'user') AS chunks_with_embeddings, round(avg(length(text)), 2) AS avg_chunk_size FROM conversations",
)
def chunk_stats(spark, sf_dir):
    return ops.chunk_stats(turn_chunks(spark, sf_dir))


_LONGEST = "(SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, CAST(conv_id AS VARCHAR) LIMIT 1)"


@REGISTRY.add(
    "c19_full_document",
    f"SELECT CAST(conv_id AS VARCHAR) AS product_name, turn AS chunk_index, text FROM conversations WHERE conv_id = {_LONGEST}",
)
def full_document(spark, sf_dir):
    chunks = turn_chunks(spark, sf_dir)
    longest = chunks.groupBy("product_name").count().orderBy(F.desc("count"), "product_name").limit(1).select("product_name").scalar()
    return ops.full_document(chunks, longest).select("product_name", "chunk_index", "text")
