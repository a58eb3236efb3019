import json

from pyspark.sql import functions as F

from claimweave.functions.ordered import dense_ids, previous_value
from claimweave.operators import taxonomy as ops


def test_grid_is_complete(spark):
    values = spark.createDataFrame(
        [("c1", "exclusion", "p1", True, "old", 1), ("c1", "", "p1", True, "new", 2), ("c1", None, "gone", True, "x", 3),
         ("c2", None, "p2", True, "t", 4), ("odd", "eligibility", "p1", True, "t", 5), (None, "exclusion", "p1", True, "t", 6)],
        "condition string, condition_type string, product_name string, condition_exist boolean, original_text string, seq int",
    )
    keys = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "condition string")
    products = spark.createDataFrame([("p1",), ("p2",)], "product_name string")
    defaults = {"condition_exist": F.lit(False), "original_text": F.lit("")}

    def grid():
        rows = ops.complete_grid(values, keys, products, ["condition"], defaults, ["condition_type"]).collect()
        assert len(rows) == 6
        return {(r["condition"], r["product_name"]): (r["condition_type"], r["condition_exist"], r["original_text"]) for r in rows}

    listed = grid()
    assert listed["c1", "p1"] == ("exclusion", True, "new") and listed["c1", "p2"] == ("exclusion", False, "")
    assert listed["c2", "p2"] == (None, True, "t") and listed["c3", "p1"] == (None, False, "")


def test_limits(spark):
    limits = ["5000", "1.5", '{"Elite": 1}', "true", '"text"', "null", None, "[1]", "{broken"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(limits)], "i int, v string").select("i", ops.normalize_limit("v").alias("l"))
    kinds = [r["l"] and r["l"]["type"] for r in df.orderBy("i").collect()]
    assert kinds == ["numeric", "numeric", "plan_tiered", "boolean", "other", None, None, "other", None]


def nested(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_flatten(spark):
    record = lambda **k: json.dumps(k)
    products = spark.createDataFrame([(1, "p1"), (2, "p2")], "id bigint, product_name string")
    rows = [
        ("b1", {
            "p1": record(condition_exist=True, parameters={"coverage_limit": {"S": 1}, "sub_limits": {"a": 2}}, original_text="t"),
            "p2": record(benefit_exist=False, condition_exist=True, parameters={}),
            "unknown": record(benefit_exist=True, parameters={}),
        }),
        ("b2", {"p2": record(benefit_exist=True, parameters={"coverage_limit": True})}),
    ]
    flat = ops.flatten_layer(nested(spark, rows, "benefit_name string, products map<string,string>"), "benefits", products)
    got = {(r["benefit_name"], r["product_name"]): r for r in flat.collect()}
    assert set(got) == {("b1", "p1"), ("b2", "p2")}
    assert got["b1", "p1"]["coverage_limit"]["type"] == "plan_tiered" and json.loads(got["b1", "p1"]["sub_limits"]) == {"a": 2}
    assert got["b2", "p2"]["coverage_limit"]["type"] == "boolean" and got["b2", "p2"]["sub_limits"] == "{}"


def test_descriptions(spark):
    rows = [
        ("medical_cover", "age_limit", "benefit_exclusion", None, None, '{"exclude_hiv": true, "age_min": 18, "plans": ["a", 1], "deep": {"x": null, "y": 1.5}}'),
        ("medical_cover", None, None, '{"Standard": 30000, "Elite": 50000}', '{"dental": 500, "more": {"eyes": "none"}}', "{}"),
    ]
    df = spark.createDataFrame(rows, "benefit_name string, condition_name string, condition_type string, raw_limit string, sub_limits string, parameters string")
    first, second = [
        ops.describe_item(df, layer).collect()[i]["description"] for i, layer in enumerate(("benefit_specific_conditions", "benefits"))
    ]
    assert first == "Benefit: Medical Cover\nCondition: Age Limit\nType: benefit_exclusion\nParameters: exclude_hiv: True; age_min: 18; plans: [a, 1]; deep: {y: 1.5}"
    assert second == "Benefit: Medical Cover\nCoverage limits: Standard: $30,000; Elite: $50,000\nSub-limits: dental: $500; more: {  eyes: none}"


def test_scenarios(spark):
    benefits = spark.createDataFrame([("p", "b1", True), ("p", "b2", True), ("p", "b3", False), ("p", "b4", True)], "product_name string, benefit_name string, benefit_exist boolean")
    benefits = benefits.withColumns({c: F.lit("x") for c in ("coverage_limit", "sub_limits", "original_text")})
    rows = [("p", "b1", f"c{i}", "t", "{}", "o", True) for i in range(30)] + [("p", "b2", "c", "t", "{}", "o", False), ("p", "b3", "c", "t", "{}", "o", True)]
    conditions = spark.createDataFrame(rows, "product_name string, benefit_name string, condition_name string, condition_type string, parameters string, original_text string, condition_exist boolean")
    whole = {r["benefit_name"]: r["related_conditions"] for r in ops.scenario_view(benefits, conditions).collect()}
    assert set(whole) == {"b1", "b2", "b4"} and whole["b2"] is None and whole["b4"] is None and len(whole["b1"]) == 30
    parts = [r["related_conditions"] for r in ops.scenario_view(benefits, conditions, max_conditions=10).filter("benefit_name = 'b1'").collect()]
    assert len(parts) > 1 and sorted(c["condition_name"] for p in parts for c in p) == sorted(c["condition_name"] for c in whole["b1"])


def test_ids_and_order_across_partitions(spark):
    names = [f"n{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "product_name string").repartition(7)
    ids = {r["product_name"]: r["id"] for r in ops.product_ids(df).collect()}
    assert ids == {n: i + 1 for i, n in enumerate(names)}
    old = spark.createDataFrame([(7, "n0003"), (9, "zz")], "id bigint, product_name string")
    kept = {r["product_name"]: r["id"] for r in ops.product_ids(df.limit(500), old).collect()}
    assert kept["n0003"] == 7 and kept["zz"] == 9 and kept["n0000"] == 10 and len(set(kept.values())) == 501
    # A hot key spans partitions.
    rows = [("hot" if i % 3 else f"k{i % 5}", i, f"v{i}") for i in range(900)]
    changes = previous_value(spark.createDataFrame(rows, "k string, t int, v string").repartition(6), "k", ["t"], "v", "before")
    last = {}
    expected = {}
    for k, t, v in rows:
        expected[k, t] = last.get(k)
        last[k] = v
    assert {(r["k"], r["t"]): r["before"] for r in changes.collect()} == expected
    assert dense_ids(df.limit(0), ["product_name"], "id").count() == 0


def test_containment_types(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}}',), ('{"a": {"b": "1"}}',), ('{"a": {"b": true}}',), ("broken",), (None,)], "j string")
    assert [ops.contains(df, "j", "$.a.b", v).count() for v in (1, "1", True, 2)] == [1, 1, 1, 0]


def test_fuzzy(spark):
    df = spark.createDataFrame([("medical cover",), ("Medical  Cover",), ("baggage",), ("",), (None,)], "n string")
    rows = {r["n"]: r["similarity"] for r in ops.fuzzy_names(df, "n", "medical cover", 0.5).collect()}
    assert rows == {"medical cover": 1.0, "Medical  Cover": 1.0}


def test_descriptions_of_a_small_scan_use_all_cores(spark):
    """One task would spell all rows; each object is read once."""
    df = spark.createDataFrame([("cover", '{"a":{"b":[1,null,true]},"c":false}')] * 8, "benefit_name string, parameters string").coalesce(1)
    found = ops.describe_item(df, "benefits")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["description"] for r in found.collect()} == {"Benefit: Cover\nParameters: a: {b: [1, None, True]}; c: False"}
