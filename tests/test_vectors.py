import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.operators import quantized
from claimweave.operators import vectors as ops


def unit(v):
    return v / np.linalg.norm(v)


def clustered(seed, n, dim=8, centres=12, noise=0.25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    # A third of all vectors sit in the first cluster.
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    return (middle[which] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, vectors, first=0, **names):
    rows = [(i + first, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{names.get('id', 'id')} bigint, embedding array<float>").repartition(3)


def brute_pairs(a, b, t, self_join, inclusive=False):
    s = np.array([unit(x.astype(float)) for x in a]) @ np.array([unit(x.astype(float)) for x in b]).T
    hit = s >= t if inclusive else s > t
    return {(i, j) for i, j in zip(*np.nonzero(hit)) if not self_join or i < j}


@pytest.mark.parametrize("threshold", [0.97, 0.8, 0.3])
@pytest.mark.parametrize("rows,shipped", [(1000, 1 << 20), (10, 1 << 20), (10, 0)])
def test_self_join_is_exact(spark, threshold, rows, shipped):
    """Ten rows per block gives some forty cells under six pivots, and several blocks in the hot ones; the second level is shipped or not."""
    vectors = clustered(1, 400)
    found = ops.similarity_join(frame(spark, vectors), None, threshold, block_rows=rows, max_tree_bytes=shipped).collect()
    pairs = [(r["left_id"], r["right_id"]) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_pairs(vectors, vectors, threshold, True)


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_two_sided_join_is_exact(spark, shipped):
    a, b = clustered(2, 150), clustered(3, 220)
    found = ops.similarity_join(frame(spark, a), frame(spark, b), 0.7, block_rows=10, inclusive=True, max_tree_bytes=shipped).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == brute_pairs(a, b, 0.7, False, True)
    counts = ops.neighbour_counts(frame(spark, a), frame(spark, b), 0.7, block_rows=10, inclusive=True, max_tree_bytes=shipped).collect()
    assert sum(r["hits"] for r in counts) == len(found)


def test_tree_spares_comparisons(spark):
    """On clustered vectors at most a tenth of all pairs is compared in vain, though a third of all rows is in one cluster."""
    vectors = clustered(21, 3000, dim=16, centres=60, noise=0.05)
    hits = len(brute_pairs(vectors, vectors, 0.99, True))
    for shipped in (1 << 20, 0):
        row = ops.compared_pairs(frame(spark, vectors), None, 0.99, block_rows=40, max_tree_bytes=shipped).first()
        assert row["all_pairs"] == 3000 * 2999 // 2 and hits <= row["compared"] <= hits + row["all_pairs"] / 10
    assert ops.compared_pairs(frame(spark, vectors).limit(0), None, 0.9).first()["compared"] == 0


def test_unusable_vectors_are_skipped(spark):
    vectors = [np.array([1.0, 0.0]), np.array([0.0, 0.0]), None, np.array([1.0, 0.01])]
    df = frame(spark, vectors)
    assert [(r["left_id"], r["right_id"]) for r in ops.similarity_join(df, None, 0.9).collect()] == [(0, 3)]
    assert ops.similarity_join(df.limit(0), None, 0.9).count() == 0
    assert {r["id"] for r in ops.dedup(df, 0.9).collect()} == {0, 1, 2}


def test_copies_are_linked_to_the_first(spark):
    base = clustered(4, 20)
    vectors = np.concatenate([base, np.repeat(base[:1], 200, axis=0), base[5:8]])
    pairs = {(r["left_id"], r["right_id"]) for r in ops.near_duplicates(frame(spark, vectors), 0.999999).collect()}
    assert pairs == {(0, i) for i in range(20, 220)} | {(5, 220), (6, 221), (7, 222)}
    kept = {r["id"] for r in ops.dedup(frame(spark, vectors), 0.8).collect()}
    remaining = sorted(kept)
    assert not brute_pairs(vectors[remaining], vectors[remaining], 0.8, True)
    s = brute_pairs(vectors, vectors, 0.8, True)
    assert kept == set(range(len(vectors))) - {j for _, j in s}


def test_near_duplicates_agree_with_their_sql_on_copies(spark, tmp_path):
    """A vector that occurs five times gives all ten pairs, and each of the five is paired with what the vector is close to."""
    import duckdb

    from claimweave.plans import catalog

    vectors = clustered(51, 120, dim=64, noise=1.5)
    vectors[[7, 40, 41, 99]] = vectors[3]
    vectors[60] = vectors[3] + np.float32(0.01)
    vectors[61] = vectors[60]
    frame(spark, vectors, id="vec_id").withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracles()["e08_near_duplicates"]).fetchall())
    got = sorted((r.left_id, r.right_id, round(r.similarity, 6)) for r in catalog.queries()["e08_near_duplicates"](spark, str(tmp_path)).collect())
    assert got == want and {(40, 99, 1.0), (60, 61, 1.0)} < set(got) and len({(i, j) for i, j, _ in got if {i, j} < {3, 7, 40, 41, 99, 60, 61}}) == 21


def test_pairs_of_a_crowd_leave_in_slices(spark, monkeypatch):
    """What a task has found leaves it by and by: pairs and counts are the same however small the slices are."""
    vectors = np.concatenate([clustered(52, 60), np.repeat(clustered(53, 1), 40, axis=0)])
    for right in (None, frame(spark, vectors[30:])):
        found = lambda: sorted((r.left_id, r.right_id) for r in ops.similarity_join(frame(spark, vectors), right, 0.7).collect())
        hits = lambda: {r.right_id: r.hits for r in ops.neighbour_counts(frame(spark, vectors), right, 0.7).collect()}
        pairs, counts = found(), hits()
        monkeypatch.setattr(ops, "_PRODUCT", 300)
        monkeypatch.setattr(ops, "_BATCH", 7)
        assert found() == pairs and hits() == counts and sum(counts.values()) == len(pairs) == len(set(pairs)) > 780
        monkeypatch.undo()


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("shipped", [4096, 30, 5])
def test_top_k_strategies_agree(spark, metric, shipped):
    """Queries shipped; corpus shipped is not (30 < 200); both blocked."""
    corpus, queries = clustered(5, 200), clustered(6, 20)
    corpus[50] = corpus[10]
    found = ops.top_k(frame(spark, corpus), frame(spark, queries, id="query_id"), 7, metric=metric, max_shipped=shipped, block_rows=60).collect()
    a, b = queries.astype(float), corpus.astype(float)
    if metric == "cosine":
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    s = np.round(a @ b.T, 12)
    for q in range(len(queries)):
        mine = [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == list(np.lexsort((np.arange(200), -s[q]))[:7])


def test_top_k_with_a_small_corpus(spark):
    corpus, queries = clustered(7, 30), clustered(8, 90)
    found = ops.top_k(frame(spark, corpus), frame(spark, queries, id="query_id"), 3, threshold=0.5, max_shipped=50).collect()
    a, b = np.array([unit(x.astype(float)) for x in queries]), np.array([unit(x.astype(float)) for x in corpus])
    s = np.round(a @ b.T, 12)
    expected = {(q, i) for q in range(90) for i in np.lexsort((np.arange(30), -s[q]))[:3] if s[q][i] > 0.5}
    assert {(r["query_id"], r["id"]) for r in found} == expected


def test_matrix_in_blocks(spark):
    a, b = clustered(9, 40), clustered(10, 25)
    whole = {(r["id"], r["b"]): r["similarity"] for r in ops.similarity_matrix(frame(spark, a), frame(spark, b, id="b"), "id", "b").collect()}
    blocked = {(r["id"], r["b"]): r["similarity"] for r in ops.similarity_matrix(frame(spark, a), frame(spark, b, id="b"), "id", "b", max_shipped=5, block_rows=16).collect()}
    assert len(whole) == 1000 and whole.keys() == blocked.keys()
    assert all(blocked[k] == pytest.approx(v) for k, v in whole.items())


def test_match_existing(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.5]), (3, None)], "id bigint, embedding array<float>")
    old = spark.createDataFrame([("a", [0.8, 0.0]), ("b", [0.0, 1.0])], "name string, embedding array<float>")
    rows = {r["id"]: (r["is_similar"], r["matched"], round(r["similarity"], 3)) for r in ops.match_existing(new, old, 0.8 - 1e-6).collect()}
    assert rows == {1: (True, "a", 0.8), 2: (False, None, 0.5), 3: (False, None, 0.0)}
    assert ops.match_existing(new, old.limit(0), 0.5).filter("is_similar").count() == 0


def sequential(new, existing, t):
    """The rule as told: visit in order, map to the most similar canonical concept so far."""
    known = [(name, unit(np.array(v, float))) for name, v in existing]
    out = {}
    for name, v in new:
        if v is None or not np.any(v):
            out[name] = name
            continue
        u = unit(np.array(v, float))
        scores = [round(float(u @ k), 12) for _, k in known]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] >= t:
            out[name] = known[best][0]
        else:
            out[name] = name
            known.append((name, u))
    return out


@pytest.mark.parametrize("threshold,listed", [(0.95, 16), (0.7, 16), (0.7, 0), (0.4, 1)])
def test_canonicalize_replays_the_visit(spark, threshold, listed):
    """``listed`` 0 never lists pairs; a small one mixes both ways."""
    limits = {"block_rows": 50, "pairs_per_row": listed}
    vectors = clustered(11, 150)
    vectors[100] = vectors[3]
    vectors[101] = vectors[3]
    new = [(f"n{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)] + [("zero", [0.0] * 8), ("none", None)]
    old = [(f"o{i}", [float(x) for x in v]) for i, v in enumerate(clustered(12, 10))]
    schema = "name string, embedding array<float>"
    shuffled = spark.createDataFrame(new, schema).orderBy(F.xxhash64("name")).repartition(5)
    ordered = shuffled.withColumn("pos", F.when(F.col("name").startswith("n0") | F.col("name").startswith("n1"), F.substring("name", 2, 3).cast("int")).otherwise(F.when(F.col("name") == "zero", 900).otherwise(901)))
    mine = {r["name"]: r["canonical"] for r in ops.canonicalize(ordered, spark.createDataFrame(old, schema), threshold, **limits).collect()}
    assert mine == sequential(new, old, threshold)
    alone = {r["name"]: r["canonical"] for r in ops.canonicalize(ordered, None, threshold, **limits).collect()}
    assert alone == sequential(new, [], threshold)


def test_canonicalize_beside_many_old_concepts(spark, monkeypatch):
    """Vectors without clusters beside old ones that are not shipped: nobody is compared in small blocks, and lone vectors keep their copies."""
    rng = np.random.default_rng(61)
    fresh, known = rng.normal(size=(300, 32)).astype(np.float32), rng.normal(size=(200, 32)).astype(np.float32)
    fresh[50:90] = known[:40]
    fresh[90:110] = known[20:40] + np.float32(0.02)
    fresh[120:140] = fresh[10:30]
    fresh[140:150] = fresh[10:20] + np.float32(0.05)
    old = [(f"o{i:03d}", [float(x) for x in v]) for i, v in enumerate([*known, known[7], known[3]])]
    new = [(f"n{i:03d}", [float(x) for x in v]) for i, v in enumerate(fresh)]
    schema = "name string, embedding array<float>"
    df = spark.createDataFrame(new, schema).withColumn("pos", F.col("name")).repartition(5)
    monkeypatch.setattr(ops, "_meet", None)
    mine = {r["name"]: r["canonical"] for r in ops.canonicalize(df, spark.createDataFrame(old, schema), 0.9, block_rows=20, max_shipped=4).collect()}
    assert mine == sequential(new, old, 0.9) and len(set(mine.values())) == 300 - 60 - 20 - 10 + 40


def test_canonicalize_on_a_chain(spark):
    """Each concept reaches only its neighbours, so every other one is canonical."""
    angles = [i * 0.5 for i in range(9)]
    new = [(f"c{i}", i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    df = spark.createDataFrame(new, "name string, pos int, embedding array<float>")
    mine = {r["name"]: r["canonical"] for r in ops.canonicalize(df, None, float(np.cos(0.6))).collect()}
    assert mine == {f"c{i}": f"c{i - i % 2}" for i in range(9)}


def test_ann_recall(spark):
    corpus, queries = clustered(13, 600), clustered(14, 20)
    df, asked = frame(spark, corpus), frame(spark, queries, id="query_id")
    index, centres = ops.ann_index(df, lists=12)
    assert index.count() == 600 and len(centres) == 12
    exact = ops.top_k(df, asked, 10)
    some = ops.recall(exact, ops.ann_top_k(index, centres, asked, 10, probes=4)).agg(F.avg("recall")).first()[0]
    full = ops.recall(exact, ops.ann_top_k(index, centres, asked, 10, probes=12)).agg(F.min("recall")).first()[0]
    assert some > 0.8 and full == 1.0


def test_ann_default_misses_nothing(spark):
    """Vectors without clusters, lists and probes as the operator has them."""
    points = np.random.default_rng(15).normal(size=(500, 64))
    df = frame(spark, points)
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index, centres = ops.ann_index(df)
    got = ops.recall(ops.top_k(df, asked, 10), ops.ann_top_k(index, centres, asked, 10)).collect()
    assert len(got) == 10 and all(r.recall == 1.0 for r in got)


def test_ann_bound_keeps_all_hits(spark):
    corpus, queries = clustered(13, 600), clustered(14, 20)
    df, asked = frame(spark, corpus), frame(spark, queries, id="query_id")
    index, centres = ops.ann_index(df, lists=12)
    found = ops.ann_top_k(index, centres, asked, 10, first=2)
    assert ops.recall(ops.top_k(df, asked, 10), found).agg(F.min("recall")).first()[0] == 1.0
    far = ops.ann_top_k(index, centres, asked, 1000, first=12)
    assert far.count() == 20 * 600  # fewer than k found: no cell is ruled out


def test_ann_cells_meet_in_blocks(spark):
    """Small blocks of queries and vectors give the exact hits, and pairs stay in the tasks."""
    corpus = clustered(13, 300)
    corpus[100:130] = corpus[100]  # copies tie, and fill a cell
    df = frame(spark, corpus)
    asked = df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    index, centres = ops.ann_index(df, lists=6)
    for limits in ({"probes": 6}, {"first": 2}):
        found = ops.ann_top_k(index, centres, asked, 10, block_rows=7, **limits)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.query_id, r.id, r.rank) for r in found.collect()}
        assert got == {(r.query_id, r.id, r.rank) for r in ops.top_k(df, asked, 10).collect()}


def test_embeddings_with_failures(spark):
    def load():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([("aa",), ("bad",), ("  ",), (None,), ("aa",), ("bbb",)], "t string")
    rows = [(r["t"], r["embedding"]) for r in ops.attach_embeddings(df, "t", load).collect()]
    assert sorted(rows, key=str) == sorted([("aa", [2.0]), ("bad", None), ("  ", None), (None, None), ("aa", [2.0]), ("bbb", [3.0])], key=str)


def test_ragged_vectors_are_an_error(spark):
    ragged = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "id int, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        ops.top_k(ragged, ragged.withColumnRenamed("id", "query_id"), 1).collect()


def test_embedding_errors_are_told(spark):
    def load():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[1.0]] * (len(texts) - ("short" in texts))

        return encode

    df = spark.createDataFrame([("good",), ("bad",), ("short",), ("good",), ("",), (None,)], "t string").coalesce(1)
    rows = sorted((str(r["t"]), r["embedding"], r["error"]) for r in ops.attach_embeddings(df, "t", load).collect())
    assert rows == [("", None, None), ("None", None, None), ("bad", None, "RuntimeError: no"), ("good", [1.0], None), ("good", [1.0], None), ("short", None, "0 vectors for one text")]


@pytest.mark.parametrize("block_rows", [1 << 17, 40])
def test_quantized_search(spark, block_rows):
    """Codes of clustered and of plain vectors; the best tenth by code is ranked exactly, in one block or in several."""
    points = np.concatenate([clustered(31, 700, dim=24), np.random.default_rng(32).normal(size=(300, 24)).astype(np.float32)])
    rows = frame(spark, [*points, None, np.zeros(24)])
    asked = rows.filter("id % 50 = 0 and embedding is not null").filter("id < 1000").select(F.col("id").alias("query_id"), "embedding")
    index = quantized.quantized_index(rows, lists=8, parts=5)
    kept = index._replace(rows=index.rows.persist())
    assert kept.rows.count() == 1000 and kept.rows.select(F.max(F.length("code"))).first()[0] == 5
    near = quantized.candidates(kept, asked, 100, block_rows=block_rows)
    assert near.count() == 20 * 100
    exact = ops.top_k(rows, asked, 10)
    found = quantized.quantized_top_k(kept, asked, 10, block_rows=block_rows)
    assert ops.recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.95
    everything = quantized.quantized_top_k(kept, asked, 10, refine=1000, block_rows=block_rows)
    assert sorted(map(str, everything.select("query_id", "id", "rank").collect())) == sorted(map(str, exact.select("query_id", "id", "rank").collect()))
    few = quantized.quantized_top_k(kept, asked, 10, probes=3, block_rows=block_rows)
    assert ops.recall(exact, few).agg(F.avg("recall")).first()[0] > 0.5
    with pytest.raises(ValueError, match="fewer lists"):
        quantized.MAX_MODEL_BYTES, old = 10, quantized.MAX_MODEL_BYTES
        try:
            quantized.quantized_index(rows, lists=8)
        finally:
            quantized.MAX_MODEL_BYTES = old


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_vectors_without_clusters_are_not_copied_to_every_cell(spark, shipped):
    """Two hundred cells of five rows, nearly all of them in reach: the cells are made larger, and the pairs are the same."""
    vectors = np.random.default_rng(41).normal(size=(1000, 32)).astype(np.float32)
    for right in (None, frame(spark, vectors)):
        placed = ops._placed(frame(spark, vectors), right, 0.4, "id", "embedding", 5, shipped)
        assert placed.rows > 5 and placed.guests.count() <= 25 * 1000
    found = {(r["left_id"], r["right_id"]) for r in ops.similarity_join(frame(spark, vectors), None, 0.4, block_rows=5, max_tree_bytes=shipped).collect()}
    assert found == brute_pairs(vectors, vectors, 0.4, True) and len(found) > 1000


def test_vectors_without_clusters_meet_in_few_blocks(spark):
    """Where every cell is in reach a row is copied once for each of a few blocks, and blocks of one table meet once."""
    vectors = np.random.default_rng(42).normal(size=(1000, 32)).astype(np.float32)
    for right in (None, frame(spark, vectors)):
        placed = ops._placed(frame(spark, vectors), right, 0.4, "id", "embedding", 5, 1 << 20)
        assert placed.guests.count() == 1000 and 1000 / placed.rows <= 4
    found = ops.nearest(frame(spark, vectors), frame(spark, vectors[:300], first=5000), 0.4, block_rows=5)
    assert {(r.right_id, r.left_id, round(r.similarity, 9)) for r in found.collect()} == {(5000 + i, i, 1.0) for i in range(300)}
    want = {i for pair in brute_pairs(vectors, vectors, 0.5, True) for i in pair}
    assert {r.id for r in ops.paired_ids(frame(spark, vectors), 0.5, block_rows=5).collect()} == want and 10 < len(want) < 990


def test_quantized_search_in_a_crowd(spark):
    """Four hundred near copies of one vector: more than are refined, and each finds its nearest; other queries read few rows."""
    rng = np.random.default_rng(43)
    middle = rng.normal(size=64)
    points = np.concatenate([middle + 0.08 * rng.normal(size=(400, 64)), rng.normal(size=(2600, 64))]).astype(np.float32)
    rows = frame(spark, points)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = quantized.quantized_index(rows, lists=8)
    index = index._replace(rows=index.rows.persist())
    share = ops.recall(ops.top_k(rows, asked, 10), quantized.quantized_top_k(index, asked, 10))
    assert share.agg(F.min("recall")).first()[0] >= 0.9
    read = {r["_q"]: r["count"] for r in quantized.candidates(index, asked, 100, k=10).groupBy("_q").count().collect()}
    assert max(n for q, n in read.items() if q < 400) <= 600 and np.mean([n for q, n in read.items() if q >= 400]) <= 300
