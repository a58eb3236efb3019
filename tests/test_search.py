"""Ranked text, resembling names and JSON containment against brute force."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from claimweave.operators import containment, postings
from claimweave.operators.taxonomy import trigrams


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_bm25(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["a", "b", "c", "rare", "the"], [9, 3, 3, 1, 30], k=rng.randint(1, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, " - "), (103, "a a, A!")]
    queries = [(1, "rare the the"), (2, "a nowhere"), (3, None), (4, ""), (5, "nowhere")]
    index = postings.postings(spark.createDataFrame(docs, "id bigint, text string").repartition(3))
    got = {(r.query_id, r.id): (r.score, r.rank) for r in postings.ranked_text(index, spark.createDataFrame(queries, "query_id int, query string"), 7).collect()}
    held = {i: words(t) for i, t in docs if words(t)}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    want = {}
    for q, text in queries:
        scores = {}
        for term in set(words(text)):
            df = sum(term in w for w in held.values())
            for i, w in held.items():
                if f := w.count(term):
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7], 1):
            want[q, i] = (pytest.approx(s), rank)
    assert got == want and {q for q, _ in got} == {1, 2}


def test_bm25_shuffles_no_terms(spark, monkeypatch):
    """Documents are counted and scored where they are read; small matrices and the join on terms give the same."""
    rng = random.Random(3)
    draw = lambda: " ".join(rng.choices(["the", "a", "b", "c", "d", "rare"], [30, 9, 3, 3, 2, 1], k=rng.randint(1, 40)))
    docs = spark.createDataFrame([(f"d{i}", draw()) for i in range(90)] + [("e0", None), ("e1", "..")], "id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", draw()) for i in range(12)] + [("none", None)], "query_id string, query string")
    index = postings.postings(docs)
    assert "Aggregate" not in index._jdf.queryExecution().optimizedPlan().toString() and index.count() == 90
    answer = lambda **options: {(r.query_id, r.id): (pytest.approx(r.score, abs=1e-8), r.rank) for r in postings.ranked_text(index, queries, 4, **options).collect()}
    whole = postings.ranked_text(index, queries, None)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    joined, got = answer(max_shipped=0), answer()
    assert got == joined and len(got) == 48
    monkeypatch.setattr(postings, "_MATRIX", 20)
    assert answer() == joined


def grams(name):
    return {("  " + w + " ")[i : i + 3] for w in words(name) for i in range(len(w) + 1)}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_fuzzy_join(spark, t):
    rng = random.Random(2)
    parts = ["travel", "cover", "covers", "medical", "medic", "trip", "delay", "delayed", "baggage", "bag", "x"]
    name = lambda: " ".join(rng.choices(parts, k=rng.randint(1, 4)))
    left, right = [name() for _ in range(80)] + [None, "", "--"], [name() for _ in range(60)] + [None, ""]
    got = {(r.left_name, r.right_name): r.similarity for r in postings.fuzzy_join(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), "l", "r", trigrams, t).collect()}
    want = {}
    for a in set(filter(None, left)):
        for b in set(filter(None, right)):
            g, h = grams(a), grams(b)
            if g and h and len(g & h) / len(g | h) >= t:
                want[a, b] = pytest.approx(len(g & h) / len(g | h))
    assert got == want and len(got) > (50 if t < 0.7 else 10)


@pytest.mark.parametrize("sets", [4, 8192])
def test_fuzzy_join_by_blocks(spark, monkeypatch, sets):
    """Blocks of few grams and stretches of few sets give what brute force gives; candidate pairs stay in the tasks."""
    rng = random.Random(5)
    parts = ["travel", "cover", "covers", "medical", "medic", "trip", "delay", "delayed", "baggage", "bag", "x"]
    name = lambda: " ".join(rng.choices(parts, k=rng.randint(1, 9)))
    left, right = {name() for _ in range(60)} | {"zz"}, {name() for _ in range(90)} | {"qq " + " ".join(f"w{i}" for i in range(400))}
    monkeypatch.setattr(postings, "_CHUNK_SETS", sets)
    found = postings.fuzzy_join(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), "l", "r", trigrams, 0.4, block_grams=300)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b): pytest.approx(len(grams(a) & grams(b)) / len(grams(a) | grams(b))) for a in left for b in right if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.4}
    assert {(r.left_name, r.right_name): r.similarity for r in found.collect()} == want and len(want) > 100
    # Stretches in this process: block against block, with sets of more than 255 grams on both sides.
    many = [list(range(i, i + 300)) for i in range(0, 200, 10)]
    table = postings.pa.table({"id": list(range(len(many))), "grams": many})
    got = postings._resembling(table, table, 0.5).to_pylist()
    assert {(r["x"], r["y"]): r["similarity"] for r in got} == {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, a in enumerate(many) for j, b in enumerate(many) if len({*a} & {*b}) / len({*a} | {*b}) >= 0.5}


def holds(value, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], p, False) for k, p in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(holds(v, p, False) for v in value) for p in pattern)
    if top and isinstance(value, list):
        return any(holds(v, pattern, False) for v in value if not isinstance(v, (dict, list)))
    if isinstance(value, (dict, list)) or isinstance(value, bool) != isinstance(pattern, bool):
        return False
    return value == pattern and (value is None) == (pattern is None)


def any_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice([1, 1.0, 2, "1", "a", True, False, None])
    if kind < 0.7:
        return {rng.choice(["a", "b", 'k."', "[0]"]): any_json(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return [any_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def test_containment(spark):
    rng = random.Random(3)
    values = [(i, json.dumps(any_json(rng, 4))) for i in range(250)] + [(900, None), (901, "not json"), (902, "null")]
    patterns = [(i, json.dumps(any_json(rng, 3))) for i in range(40)] + [(90, '{"a":{}}'), (91, "[[]]"), (92, "null"), (93, "oops"), (94, None), (95, '{"a":[1]}'), (96, "[]"), (97, "1")]
    found = containment.contains_any(spark.createDataFrame(values, "id int, v string").repartition(3), spark.createDataFrame(patterns, "pattern_id int, pattern string"), "id", "v")
    parse = lambda t: json.loads(t)
    want = {(i, j) for i, v in values if v and v != "not json" for j, p in patterns if p and p != "oops" and holds(parse(v), parse(p))}
    got = [(r.id, r.pattern_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert containment.contains_any(spark.createDataFrame(values, "id int, v string"), spark.createDataFrame([], "pattern_id int, pattern string"), "id", "v").count() == 0


def test_containment_keeps_nodes_like_a_pattern(spark):
    """Rows do not meet by shape in one task, and what no pattern has is not carried along."""
    values = spark.createDataFrame([(i, json.dumps({"a": i % 2, "b": {"c": [i]}})) for i in range(20)], "id int, v string")
    patterns = spark.createDataFrame([(1, '{"a":1}'), (2, "{}")], "pattern_id int, pattern string")
    as_levels = lambda df, text: df.select(F.col(df.columns[0]).alias("row"), F.parse_json(text).alias("value"))
    wanted = containment._levels(as_levels(patterns, "pattern"))
    assert [level.count() for level in containment._levels(as_levels(values, "v"), wanted)] == [20, 10]
    found = containment.contains_any(values, patterns, "id", "v")
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 30


def test_hybrid_scales_both_scores(spark):
    docs = spark.createDataFrame([(1, "cover trip", 0.0), (2, "trip", 1.0), (3, None, 0.5)], "id int, text string, s double")
    found = postings.text_and_vector(docs, postings.postings(docs), "cover", F.col("s"), k=3).collect()
    assert [(r.id, r.score) for r in found] == [(2, pytest.approx(0.7)), (3, pytest.approx(0.35)), (1, pytest.approx(0.3))]


@pytest.mark.parametrize("name", ["e13_hybrid_search", "e13_ranked_hybrid"])
def test_scores_that_are_told_alike_are_ties(spark, tmp_path, name):
    """The SQL ranks by scores of six digits: of eleven documents that these don't tell apart the nine with the smallest ids follow the best one."""
    import duckdb

    from claimweave.plans import catalog

    text = lambda e, t: "x" * (10000 - e - t) + "e" * e + "t" * t
    docs = [(i, text(1000, 1001)) for i in range(10)] + [(10, text(1000, 1000)), (11, "the"), (12, "e" * 20)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracles()[name]).fetchall())
    got = sorted((r.id, round(r.score, 6)) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got == want and [i for i, _ in want] == [*range(9), 11]
