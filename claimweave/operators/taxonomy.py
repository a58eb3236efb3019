"""Policy taxonomy: completion, validation, flattening, views and statistics.

A layer in nested form is ``key columns, ..., products map<string, string>``,
each map value being the JSON of one product's record. In flat form it is one
row per (product, key).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import variants
from claimweave.functions.ordered import dense_ids
from claimweave.functions.variants import kind, kind_of, members, parse, text
from claimweave.session import spread

# Keys in one slice of a completion grid, about.
_SLICE_KEYS = 2048


def _filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def unique_keys(layer: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct names (or name tuples), all parts non-empty."""
    nonempty = reduce(lambda a, b: a & b, [_filled(c) for c in columns])
    return layer.select(*columns).filter(nonempty).distinct().orderBy(*columns)


def approved_values(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits judged extractions into approved values, failures and counts.

    ``judged`` has ``status, product_name, text_index, validations``, the last an
    array of ``struct<item_index, approve, final_value>``.
    """
    usable = (F.col("status") == "success") & F.col("validations").isNotNull()
    approved = (
        judged.filter(usable)
        .select("product_name", "text_index", F.inline("validations"))
        .filter(F.col("approve") & _filled("final_value"))
        .drop("approve")
    )
    failures = judged.filter(~F.coalesce(usable, F.lit(False))).drop("validations")
    kept = F.size(F.filter("validations", lambda v: v["approve"] & v["final_value"].isNotNull() & (v["final_value"] != "")))
    counts = judged.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(usable & (kept > 0)).alias("approved_chunks"),
        F.coalesce(F.sum(F.when(usable, kept)), F.lit(0)).cast("bigint").alias("items"),
        F.count_if(~F.coalesce(usable, F.lit(False))).alias("failures"),
    )
    return approved, failures, counts


def _product_grid(keys: DataFrame, products: DataFrame, product: str) -> DataFrame:
    """Every key with every product: the grid is the result, so its size is asked for.

    Keys are dealt to slices, as many as their number asks for, and every product visits every slice,
    so the join is by slice number and no side is collected.
    """
    names = products.select(product).distinct()
    slices = max(1, -(-keys.count() // _SLICE_KEYS))
    placed = keys.withColumn("_slice", F.pmod(F.xxhash64(*keys.columns), F.lit(slices)).cast("int"))
    visiting = names.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return placed.join(visiting, "_slice").drop("_slice")


def complete_grid(
    values: DataFrame,
    keys: DataFrame,
    products: DataFrame,
    key_columns: Sequence[str],
    defaults: Mapping[str, Column],
    last_filled: Sequence[str] = (),
    product: str = "product_name",
    seq: str = "seq",
) -> DataFrame:
    """Every key for every product, with defaults where nothing was extracted.

    The value of the highest ``seq`` wins per (key, product); each column in
    ``last_filled`` takes its last non-empty value per key. Keys and products
    that are not listed are dropped.
    """
    fields = list(defaults)
    latest = values.groupBy(*key_columns, product).agg(F.max_by(F.struct(*fields), F.col(seq)).alias("_value"))
    grid = _product_grid(keys.select(*key_columns).distinct(), products, product)
    full = grid.join(latest, [*key_columns, product], "left")
    if last_filled:
        per_key = values.groupBy(*key_columns).agg(
            *[F.max_by(F.when(_filled(c), F.col(c)), F.when(_filled(c), F.col(seq))).alias(c) for c in last_filled]
        )
        full = full.join(per_key, list(key_columns), "left")
    return full.select(
        *key_columns,
        *last_filled,
        product,
        *[F.coalesce(F.col("_value")[f], default).alias(f) for f, default in defaults.items()],
    )


def assemble(layers: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Sorted union of the layers' product names, and one count row per layer plus the total."""
    products = reduce(
        DataFrame.union, [layer.select(F.explode(F.map_keys("products")).alias("product_name")) for layer in layers.values()]
    )
    counts = reduce(
        DataFrame.union,
        [layer.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("items")) for name, layer in layers.items()],
    )
    return products.distinct().orderBy("product_name"), counts.union(counts.agg(F.lit("total"), F.sum("items")))


# --- validation ----------------------------------------------------------------

# Required keys, required product keys and allowed types per layer.
_RULES = {
    "general_conditions": {
        "required": ["condition", "condition_type", "products"],
        "strings": ["condition"],
        "types": ["eligibility", "exclusion"],
        "product": ["condition_exist", "original_text", "parameters"],
        "expected": [],
    },
    "benefits": {
        "required": ["benefit_name", "products"],
        "strings": ["benefit_name"],
        "types": [],
        "product": ["condition_exist", "parameters"],
        "expected": ["coverage_limit"],
    },
    "benefit_specific_conditions": {
        "required": ["benefit_name", "condition", "condition_type", "products"],
        "strings": ["benefit_name", "condition"],
        "types": ["benefit_eligibility", "benefit_exclusion"],
        "product": ["condition_exist", "original_text", "parameters"],
        "expected": [],
    },
}


def _missing(fields: Column, required: Sequence[str]) -> Column:
    """The required keys a map lacks, comma-joined; NULL when there are none."""
    lacking = F.array_except(F.array(*[F.lit(r) for r in sorted(required)]), F.map_keys(fields))
    return F.when(F.size(lacking) > 0, F.array_join(lacking, ","))


def _is(fields: Column, key: str, wanted: str) -> Column:
    return F.coalesce(variants.kind(fields[key]) == wanted, F.lit(False))


def validate_items(df: DataFrame, layer: str, item: str = "item") -> DataFrame:
    """Structure checks of one taxonomy layer over a JSON column.

    Adds ``errors`` and ``warnings`` (arrays of text) and ``is_valid``.
    """
    rules = _RULES[layer]
    checked = df.withColumn("_f", variants.members(variants.parse(item)))
    fields = F.col("_f")
    has = lambda key: F.array_contains(F.map_keys(fields), key)
    tests = [
        F.when(fields.isNull(), F.lit("item: not an object")),
        F.concat(F.lit("missing: "), _missing(fields, rules["required"])),
        *[F.when(fields.isNotNull() & ~_is(fields, key, "string"), F.lit(f"{key}: not a string")) for key in rules["strings"]],
    ]
    if rules["types"]:
        allowed = F.coalesce(
            (variants.kind(fields["condition_type"]) == "string") & variants.text(fields["condition_type"]).isin(rules["types"]), F.lit(False)
        )
        tests.append(F.when(has("condition_type") & ~allowed, F.lit("condition_type: must be one of " + ", ".join(rules["types"]))))
    tests.append(F.when(has("products") & ~_is(fields, "products", "object"), F.lit("products: not an object")))

    def product_errors(entry: Column) -> Column:
        body, label = entry["body"], F.concat(F.lit("product "), entry["key"], F.lit(": "))
        present = lambda key: F.array_contains(F.map_keys(body), key)
        return F.array(
            F.when(body.isNull(), F.concat(label, F.lit("not an object"))),
            F.concat(label, F.lit("missing "), _missing(body, rules["product"])),
            F.when(present("condition_exist") & ~_is(body, "condition_exist", "boolean"), F.concat(label, F.lit("condition_exist not boolean"))),
            F.when(present("parameters") & ~_is(body, "parameters", "object"), F.concat(label, F.lit("parameters not an object"))),
        )

    def product_warnings(entry: Column) -> Column:
        parameters = F.try_variant_get(entry["body"]["parameters"], "$", "map<string,variant>")
        return F.array(
            *[
                F.when(
                    parameters.isNotNull() & ~F.array_contains(F.map_keys(parameters), key),
                    F.concat(F.lit("product "), entry["key"], F.lit(f": missing {key}")),
                )
                for key in rules["expected"]
            ]
        )

    products = F.transform(
        F.map_entries(F.coalesce(F.try_variant_get(fields["products"], "$", "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))),
        lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "map<string,variant>").alias("body")),
    )
    checked = checked.withColumn("_p", products)
    warnings = F.array_compact(F.flatten(F.transform("_p", product_warnings))) if rules["expected"] else F.array().cast("array<string>")
    return (
        checked.withColumn("errors", F.array_compact(F.concat(F.array(*tests), F.flatten(F.transform("_p", product_errors)))))
        .withColumn("warnings", warnings)
        .withColumn("is_valid", F.size("errors") == 0)
        .drop("_f", "_p")
    )


# --- normalising and flattening ------------------------------------------------


def normalize_exist(df: DataFrame) -> DataFrame:
    """``benefit_exist`` falls back to ``condition_exist``, then to false."""
    return df.withColumn("benefit_exist", F.coalesce("benefit_exist", "condition_exist", F.lit(False)))


def normalize_limit(limit: str | Column) -> Column:
    """A JSON limit as ``struct<value string, type string>``; NULL stays NULL.

    Booleans are tested before numbers.
    """
    value = variants.parse(limit)
    shape = variants.kind(value)
    label = F.when(shape == "boolean", "boolean").when(shape == "number", "numeric").when(shape == "object", "plan_tiered").otherwise("other")
    return F.when(shape.isNotNull() & (shape != "null"), F.struct(variants.text(value).alias("value"), label.alias("type")))


def product_ids(names: DataFrame, existing: DataFrame | None = None, product: str = "product_name") -> DataFrame:
    """A dense id per product name in name order; known names keep theirs, new ones follow."""
    wanted = names.select(product).filter(F.col(product).isNotNull()).distinct()
    if existing is None:
        return dense_ids(wanted, [product], "id").select("id", product)
    fresh = dense_ids(wanted.join(existing, product, "left_anti"), [product], "id")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return existing.select("id", product).unionByName(fresh.select((F.col("id") + last).alias("id"), product))


def flatten_layer(df: DataFrame, layer: str, products: DataFrame) -> DataFrame:
    """Existing records of known products, one row each.

    Benefits take their limit and sub-limits from the parameters.
    """
    names = {
        "general_conditions": {"condition": "condition_name"},
        "benefits": {"benefit_name": "benefit_name"},
        "benefit_specific_conditions": {"benefit_name": "benefit_name", "condition": "condition_name"},
    }[layer]
    rows = df.select(
        *[F.col(source).alias(target) for source, target in names.items()],
        *(["condition_type"] if layer != "benefits" else []),
        F.explode("products").alias("product_name", "_json"),
    ).withColumn("_v", variants.parse("_json"))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    parameters = F.to_json(get("$.parameters", "variant"))
    common = {"original_text": get("$.original_text", "string"), "parameters": parameters}
    if layer == "benefits":
        rows = normalize_exist(rows.withColumns({"benefit_exist": get("$.benefit_exist", "boolean"), "condition_exist": get("$.condition_exist", "boolean"), **common}))
        rows = rows.drop("condition_exist").withColumns(
            {
                "coverage_limit": normalize_limit(F.to_json(get("$.parameters.coverage_limit", "variant"))),
                "sub_limits": F.coalesce(F.to_json(get("$.parameters.sub_limits", "variant")), F.lit("{}")),
            }
        )
        kept = rows.filter("benefit_exist")
    else:
        kept = rows.withColumns({"condition_exist": get("$.condition_exist", "boolean"), **common}).filter("condition_exist")
    known = products.select(F.col("id").alias("product_id"), "product_name")
    return kept.drop("_json", "_v").join(known, "product_name")


# --- text form of an item ------------------------------------------------------


def _depth(json: Column) -> Column:
    """How deep objects are nested, by the braces outside strings; 0 without any."""
    braces = F.regexp_replace(F.regexp_replace(json, r'"(\\.|[^"\\])*"', ""), r"[^{}]", "")

    def step(state: Column, brace: Column) -> Column:
        now = state["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(F.split(braces, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda state: state["top"])


def _entries(json: Column) -> Column:
    """An object's members in the order they are written, as structs of key and raw text."""
    return F.map_entries(F.from_json(json, "map<string,string>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named; inside lambdas nothing else sees to that."""
    return F.get(F.transform(F.array(value), use), 0)


def _shown(member: Column, raw: Column, sort: Column | None = None) -> Column:
    """A scalar as text; truth values in title case, a list in brackets."""
    sort = kind(member) if sort is None else sort
    item = lambda v: _once(F.struct(v.alias("v"), kind(v).alias("kind")), lambda x: F.when(x["kind"] == "boolean", F.initcap(text(x["v"]))).when(x["kind"] == "null", "None").otherwise(text(x["v"])))
    items = F.transform(F.try_variant_get(member, "$", "array<variant>"), item)
    return (
        F.when(sort == "array", F.concat(F.lit("["), F.array_join(items, ", ", "None"), F.lit("]")))
        .when(sort == "boolean", F.initcap(raw))
        .otherwise(F.coalesce(raw, F.lit("None")))
    )


def _amount(member: Column, raw: Column, sort: Column | None = None) -> Column:
    """A number as dollars (a truth value counts as 1 or 0), anything else as it is."""
    sort = kind(member) if sort is None else sort
    number = F.when(sort == "boolean", F.try_variant_get(member, "$", "boolean").cast("double")).when(sort == "number", F.try_variant_get(member, "$", "double"))
    return F.coalesce(F.concat(F.lit("$"), F.format_number(number, 0)), _shown(member, raw, sort))


def _listing(json: Column, value: Callable[..., Column], deepest: int, indent: str = "", nulls: bool = True, depth: int = 0) -> Column:
    """``key: value`` of every member, joined by semicolons; objects follow in braces, each of ``deepest`` levels indented further."""

    def one(entry: Column) -> Column:
        plain = value(entry["member"], entry["value"], entry["kind"])
        if depth + 1 < deepest:
            inner = _listing(entry["value"], value, deepest, indent, nulls, depth + 1)
            plain = F.when(entry["kind"] == "object", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(plain)
        return F.concat(F.lit(indent * depth), entry["key"], F.lit(": "), plain)

    def told(known: Column) -> Column:
        """Each member with its kind, so that the object is read once and a member's kind is told once."""
        entries = _entries(json) if nulls else F.filter(_entries(json), lambda e: e["value"].isNotNull())
        found = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.element_at(known, e["key"]).alias("member")))
        schemas = F.transform(found, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["member"].alias("member"), F.schema_of_variant(e["member"]).alias("schema")))
        kinds = F.transform(schemas, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["member"].alias("member"), kind_of(e["schema"]).alias("kind")))
        return F.array_join(F.transform(kinds, one), "; ")

    return _once(members(parse(json)), told)


def describe_item(df: DataFrame, layer: str, name: str = "description", deepest: int | None = None) -> DataFrame:
    """Text form of a flat row, for an embedding model. JSON columns are strings.

    One line each for the names, the type, the limit, the sub-limits and the parameters,
    as far as they are there; JSON that cannot be read counts as missing. Objects are spelled to
    the deepest level there is, which one pass over the JSON finds unless ``deepest`` gives it;
    what lies deeper than a given one is shown as JSON. Spelling costs more than moving rows, so a scan of few tasks is spread.
    """
    df = spread(df)
    nested = [c for c in ("raw_limit", "sub_limits", "parameters") if c in df.columns]
    if deepest is None and nested:
        deepest = df.agg(F.max(F.greatest(*[F.coalesce(_depth(F.col(c).cast("string")), F.lit(0)) for c in nested], F.lit(0)))).first()[0]
    levels = max(1, deepest or 0)
    column = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    title = lambda c: F.initcap(F.replace(column(c), F.lit("_"), F.lit(" ")))
    limit, limits = column("raw_limit"), parse(column("raw_limit"))
    filled = lambda c: F.size(F.coalesce(_entries(column(c)), F.array().cast("array<struct<key:string,value:string>>"))) > 0
    kind_of_limit = kind(limits)
    shown_limit = (
        F.when(kind_of_limit == "object", F.concat(F.lit("Coverage limits: "), _listing(limit, _amount, levels)))
        .when(kind_of_limit.isin("number", "boolean"), F.concat(F.lit("Coverage limit: "), _amount(limits, limit)))
        .when(kind_of_limit != "null", _shown(limits, text(limits)))
    )
    has_type = {"general_conditions": F.lit(True), "benefit_specific_conditions": column("condition_type") != ""}.get(layer, F.lit(False))
    lines = [
        F.concat(F.lit("Benefit: "), title("benefit_name")),
        F.concat(F.lit("Condition: "), title("condition_name")),
        F.when(has_type, F.concat(F.lit("Type: "), F.coalesce(column("condition_type"), F.lit("None")))),
        shown_limit,
        F.when(filled("sub_limits"), F.concat(F.lit("Sub-limits: "), _listing(column("sub_limits"), _amount, levels, indent="  "))),
        F.when(filled("parameters"), F.concat(F.lit("Parameters: "), _listing(column("parameters"), _shown, levels, nulls=False))),
    ]
    return df.withColumn(name, F.concat_ws("\n", *lines))


# --- views ---------------------------------------------------------------------


def comparison_view(benefits: DataFrame, conditions: DataFrame) -> DataFrame:
    """Existing benefits and existing conditions side by side, in no order."""
    none = F.lit(None).cast("string")
    left = benefits.filter("benefit_exist").select(
        F.lit("benefit").alias("item_type"), F.col("benefit_name").alias("item_name"), "product_name",
        F.col("benefit_exist").alias("exists"), "coverage_limit", "sub_limits", "parameters",
    )
    right = conditions.filter("condition_exist").select(
        F.lit("condition").alias("item_type"), F.col("condition_name").alias("item_name"), "product_name",
        F.col("condition_exist").alias("exists"), none.alias("coverage_limit"), none.alias("sub_limits"), "parameters",
    )
    return left.unionByName(right)


def _eligibility(prefix: str) -> Column:
    kind = F.col("condition_type")
    return F.when(kind == f"{prefix}exclusion", "excluded").when(kind == f"{prefix}eligibility", "eligible").otherwise("unknown")


def eligibility_view(conditions: DataFrame, benefit_conditions: DataFrame) -> DataFrame:
    """All existing conditions as excluded, eligible or unknown."""
    shape = ["product_name", "condition_name", "condition_type", "parameters", "original_text"]
    general = conditions.filter("condition_exist").select(*shape, _eligibility("").alias("eligibility_status"))
    scoped = (
        benefit_conditions.filter("condition_exist")
        .withColumn("condition_name", F.concat("benefit_name", F.lit(": "), "condition_name"))
        .select(*shape, _eligibility("benefit_").alias("eligibility_status"))
    )
    return general.unionByName(scoped)


def scenario_view(benefits: DataFrame, benefit_conditions: DataFrame, max_conditions: int = 10_000) -> DataFrame:
    """Existing benefits with their existing conditions nested; NULL when there are none.

    A benefit with more than ``max_conditions`` conditions comes as several rows
    (``part`` 0, 1, ...), each holding a share, so no array grows without bound.
    """
    keys = ["product_name", "benefit_name"]
    existing = benefit_conditions.filter("condition_exist")
    parts = existing.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(max_conditions)).alias("_parts")).filter("_parts > 1")
    nested = (
        existing.join(parts, keys, "left")
        .withColumn("part", F.conv(F.substring(F.md5("condition_name"), 1, 8), 16, 10).cast("bigint") % F.coalesce("_parts", F.lit(1).cast("bigint")))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("condition_name", "condition_type", "parameters", "original_text"))).alias("related_conditions"))
    )
    return (
        benefits.filter("benefit_exist")
        .withColumnRenamed("original_text", "benefit_text")
        .select(*keys, "benefit_exist", "coverage_limit", "sub_limits", "benefit_text")
        .join(nested, keys, "left")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    )


def taxonomy_stats(products: DataFrame, conditions: DataFrame, benefits: DataFrame, benefit_conditions: DataFrame) -> DataFrame:
    """Eight distinct counts per product.

    Each child is counted on its own before the join, so the three one-to-many
    sides never multiply.
    """

    def distinct_if(column: str, kind: str | None = None) -> Column:
        return F.count_distinct(F.col(column) if kind is None else F.when(F.col("condition_type") == kind, F.col(column)))

    general = conditions.filter("condition_exist").groupBy("product_id").agg(
        distinct_if("condition_name").alias("total_general_conditions"),
        distinct_if("condition_name", "exclusion").alias("exclusion_count"),
        distinct_if("condition_name", "eligibility").alias("eligibility_count"),
    )
    covered = benefits.filter("benefit_exist").groupBy("product_id").agg(distinct_if("benefit_name").alias("total_benefits"))
    scoped = benefit_conditions.filter("condition_exist").groupBy("product_id").agg(
        distinct_if("condition_name").alias("total_benefit_conditions"),
        distinct_if("condition_name", "benefit_exclusion").alias("benefit_exclusion_count"),
        distinct_if("condition_name", "benefit_eligibility").alias("benefit_eligibility_count"),
    )
    joined = products.select(F.col("id").alias("product_id"), "product_name")
    for child in (general, covered, scoped):
        joined = joined.join(child, "product_id", "left")
    return joined.drop("product_id").fillna(0)


def comparison_matrix(view: DataFrame, products: Sequence[str] | None = None, value: str = "coverage_limit") -> DataFrame:
    """Items as rows, products as columns: those given, or else all there are.

    Of several values of an item and product the largest counts.
    """
    grouped = view.groupBy("item_type", "item_name")
    return (grouped.pivot("product_name") if products is None else grouped.pivot("product_name", list(products))).agg(F.max(value))


def contains(df: DataFrame, column: str, path: str, value: str | int | float | bool) -> DataFrame:
    """Rows whose JSON column holds ``value`` under ``path``."""
    wanted = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]
    found = variants.parse(column)
    shape = {"boolean": "boolean", "bigint": "number", "double": "number", "string": "string"}[wanted]
    same_kind = variants.kind(F.try_variant_get(found, path, "variant")) == shape
    return df.filter(same_kind & (F.try_variant_get(found, path, wanted) == F.lit(value)))


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def fuzzy_names(df: DataFrame, column: str, query: str, min_similarity: float = 0.3) -> DataFrame:
    """Names whose trigram overlap with the query is at least ``min_similarity``.

    Each distinct name is scored once.
    """
    names = df.select(column).filter(F.col(column).isNotNull()).distinct()
    mine, theirs = trigrams(F.col(column)), trigrams(F.lit(query))
    overlap = F.size(F.array_intersect(mine, theirs)).cast("double")
    score = F.coalesce(F.try_divide(overlap, F.size(F.array_union(mine, theirs)).cast("double")), F.lit(0.0))
    return names.withColumn("similarity", score).filter(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), column)


# --- chunk tables --------------------------------------------------------------


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct("product_name").alias("total_products"),
        F.coalesce(F.sum("char_count"), F.lit(0)).cast("bigint").alias("total_characters"),
        F.count("original_embedding").alias("chunks_with_embeddings"),
        F.round(F.avg("char_count"), 2).alias("avg_chunk_size"),
    )


def full_document(chunks: DataFrame, product: str | Column) -> DataFrame:
    """All chunks of one product in order."""
    return chunks.filter(F.col("product_name") == product).orderBy("chunk_index")
