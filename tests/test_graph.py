import math

from claimweave.operators import annotate as model
from claimweave.operators import graph as ops

QUESTION = "struct<question:string,reasoning_guidance:string,knowledge_facts:array<string>,final_answer:string,best_to_know:string>"
VECTORS = {"a": [1.0, 0, 0], "b": [0, 1.0, 0], "c": [0, 0, 1.0], "a2": [0.99, 0.05, 0], "d": [0.6, 0.6, 0.6], "alias": [1.0, 0, 0]}


def graph(spark, edges=(("a", "b"),), names=("a", "b", "c")):
    nodes = spark.createDataFrame([(n, [float(x) for x in VECTORS[n]]) for n in names], "name string, embedding array<float>")
    both = [e for s, t in edges for e in ((s, t), (t, s))]
    mapping = spark.createDataFrame([(n, n) for n in names] + [("alias", "a")], "alias string, canonical string")
    return ops.Graph(nodes, spark.createDataFrame(both, "src string, dst string"), mapping)


def proposals(spark, *rows):
    return spark.createDataFrame([("success", c, list(n)) for c, n in rows], "status string, center_concept string, new_concepts array<string>")


def embed(spark):
    table = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in VECTORS.items()], "name string, embedding array<float>")
    return lambda names: names.join(table, "name", "left")


def pairs(g):
    return {(r["src"], r["dst"]) for r in g.edges.collect()}


def test_expand_counts(spark):
    old = graph(spark)
    # A known alias twice, a new alias, a repeat, a blank, and a concept that maps onto its own centre.
    asked = proposals(spark, ("b", ["alias", " alias ", "a2", "d", "d", " "]), ("a", ["a2", "a"]), ("gone", ["c"]))
    new, stats = ops.expand(old, asked, 0.9, embed(spark))
    row = stats.first()
    assert (row["proposals"], row["nodes_added"], row["duplicates"]) == (8, 1, 3)
    assert row["add_rate"] == 1 / 8
    assert pairs(new) == {("a", "b"), ("b", "a"), ("b", "d"), ("d", "b")}
    assert row["edges_added"] == 1
    assert {r["alias"]: r["canonical"] for r in new.mapping.collect()} == {"a": "a", "b": "b", "c": "c", "alias": "a", "a2": "a", "d": "d"}
    assert pairs(old) == {("a", "b"), ("b", "a")}


def test_expand_with_nothing(spark):
    _, stats = ops.expand(graph(spark), proposals(spark, ("a", [])), 0.9, embed(spark))
    assert stats.first()["add_rate"] == 0.0


def test_connectivity(spark):
    row = ops.connectivity(graph(spark), proposals(spark, ("a", ["c", "c", "b", "a", " c"]), ("b", ["d"]))).first()
    assert (row["new_edges"], row["old_edges"], row["connectivity_rate"]) == (2, 1, 2.0)
    assert math.isinf(ops.connectivity(graph(spark, ()), proposals(spark, ("a", ["c"]))).first()["connectivity_rate"])
    assert ops.connectivity(graph(spark), proposals(spark, ("a", []))).first()["connectivity_rate"] == 0.0


def test_grow_stops(spark):
    def propose(g):
        return proposals(spark, ("a", ["d", "c"]), ("b", []))

    rounds, history = ops.grow(graph(spark), propose, embed(spark), 0.9, max_rounds=5)
    rows = rounds.orderBy("round").collect()
    assert [(r["nodes_added"], r["edges_added"], r["skipped"], r["nodes"], r["edges"]) for r in rows] == [(1, 2, 1, 4, 3), (0, 0, 1, 4, 3)]
    assert len(history) == 2 and history[0].nodes.count() == 4


def test_facts_and_products(spark):
    facts = spark.createDataFrame([("fact", [0.9, 0.1, 0.0]), ("fact 2", [0.0, 0.0, 2.0])], "name string, embedding array<float>")
    linked = ops.link_facts(graph(spark), facts, 1)
    assert pairs(linked) == {("a", "b"), ("b", "a"), ("fact", "a"), ("a", "fact"), ("fact 2", "c"), ("c", "fact 2")}
    more = ops.add_products(linked, spark.createDataFrame([("p",), ("a",), ("p",)], "product_name string"))
    assert more.nodes.count() == 6
    assert ops.unique_edges(ops.Graph(graph(spark).nodes, linked.edges, linked.mapping)).collect() == [("a", "b")]


def results(spark, rows):
    return spark.createDataFrame(rows, f"status string, id bigint, concepts array<string>, questions array<{QUESTION}>")


def question(text="q", answer="a", hint="h"):
    return (text, "r", ["f1", "f2"], answer, hint)


def test_conversion(spark):
    rows = [
        ("success", 1, ["x"], [question(), question(answer="")]),
        ("failed", 2, ["x"], [question()]),
        ("success", 3, ["x", "y"], []),
        ("success", 4, ["x", "y"], [question(hint=None)]),
        ("success", 5, [], [question()]),
        ("success", 6, ["x", "y", "z"], [question()]),
    ]
    qa, counts = ops.to_qa(results(spark, rows))
    assert {(r["id"], r["question_index"]) for r in qa.collect()} == {(1, 0), (4, 0), (6, 0)}
    assert counts.first().asDict() == {
        "processed": 6, "generated": 3, "converted": 3, "failed": 2, "skipped": 2, "single_items": 2, "pair_items": 3
    }
    assert ops.qa_with_hint(qa).count() == 2
    nodes, other = ops.concept_nodes(qa)
    assert {r["memory"] for r in nodes.collect()} == {"x", "y"}
    assert [r["id"] for r in other.collect()] == [6]
    questions = ops.qa_nodes(qa, nodes)
    assert questions.count() == 2
    # An item with an unknown concept is skipped.
    assert ops.qa_nodes(qa, nodes.filter("memory = 'x'")).count() == 1
    memory = questions.filter("kind = 'concept_qa'").first()["memory"]
    assert memory == "Question: q\n\nReasoning Guidance: r\n\nKnowledge Facts: f1; f2\n\nAnswer: a\n\nBest to Know: h"
    edges = ops.qa_edges(questions)
    assert sorted(r["type"] for r in edges.collect()) == ["PARENT"] * 3 + ["RELATE_TO"]
    stats = {(r["part"], r["label"]): r["n"] for r in ops.graph_stats(nodes.select("id", "kind").unionByName(questions.select("id", "kind")), edges).collect()}
    assert stats["nodes", "concept"] == 2 and stats["nodes", "relation_qa"] == 1 and stats["edges", "total"] == 4


def test_annotate_isolates_failures(spark):
    def load():
        def call(frame):
            if (frame["id"] == 7).any():
                raise ValueError("seven")
            return [f"r{i}" for i in frame["id"]]

        return call

    rows = model.annotate(spark.range(10).coalesce(1), load, batch=4).collect()
    assert {r["id"]: r["response"] for r in rows} == {i: None if i == 7 else f"r{i}" for i in range(10)}
    assert [(r["status"], r["error"]) for r in rows if r["id"] == 7] == [("error", "seven")]


def test_growth_over_near_copies_agrees_with_its_sql(spark, tmp_path):
    """Vectors of near copies: new concepts with vectors of their own stay apart, as the SQL says."""
    import duckdb
    import numpy as np

    from claimweave.plans import catalog

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(4, 64))
    vectors = [(i, [float(x) for x in middle[i % 4] + 0.01 * rng.normal(size=64)], i % 4) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = duck.execute(catalog.oracles()["f06_grow"])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(row) for row in cursor.fetchall())
    got = sorted(tuple(round(v, 6) for v in row) for row in catalog.queries()["f06_grow"](spark, str(tmp_path)).select(*names).collect())
    assert got == want and len(got) == 2
