"""Vector operators over the embeddings, with queries derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import vector as vec
from claimweave.operators import postings, quantized
from claimweave.operators import vectors as ops
from claimweave.plans.registry import Registry
from claimweave.plans.tables import table
from claimweave.session import cut_lineage, scratch_path
from claimweave.sources.writers import write_table

REGISTRY = Registry.empty()

_E = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CENTRES = (
    ", centres AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS a FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i) GROUP BY label)"
    ", mean AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS a FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i))"
)
_WITH = _E + _CENTRES
_COS = "list_cosine_similarity"
_DOT = "list_dot_product"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def centres(spark, sf_dir):
    """Mean vector per label."""
    parts = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    # One entry per dimension.
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("embedding"))


def mean_vector(spark, sf_dir):
    """Mean of all vectors as a literal: one number per dimension, as a caller's query vector is."""
    parts = vectors(spark, sf_dir).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    ordered = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]))
    return F.lit(ordered.first()[0])


@REGISTRY.add("e01_similarity", _WITH + f" SELECT vec_id AS id, round({_COS}(v, m), 6) + 0 AS cosine, round({_DOT}(v, m), 6) + 0 AS dot FROM e, mean")
def similarity(spark, sf_dir):
    mean = mean_vector(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", vec.cosine("embedding", mean).alias("cosine"), vec.dot("embedding", mean).alias("dot"))


@REGISTRY.add("e02_similarity_matrix", _WITH + f" SELECT vec_id AS id, c.label AS centre, round({_COS}(v, c), 6) + 0 AS similarity FROM e, centres AS c(label, c)")
def similarity_matrix(spark, sf_dir):
    return ops.similarity_matrix(vectors(spark, sf_dir), centres(spark, sf_dir).withColumnRenamed("label", "centre"), "id", "centre", max_shipped=4, block_rows=100)


_SCORED = f", scored AS (SELECT c.label AS query_id, vec_id AS id, round({_COS}(v, c.c), 12) AS s FROM e, centres AS c(label, c))"
_RANKED = (
    " SELECT query_id, id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored{where}) WHERE rank <= 10"
)


@REGISTRY.add("e03_top_k", _WITH + _SCORED + _RANKED.format(where=""))
def top_k(spark, sf_dir):
    return ops.top_k(vectors(spark, sf_dir), centres(spark, sf_dir).withColumnRenamed("label", "query_id"), 10, max_shipped=4, block_rows=100)


@REGISTRY.add("e03_top_k_above_threshold", _WITH + _SCORED + _RANKED.format(where=" WHERE s > 0.35"))
def top_k_above_threshold(spark, sf_dir):
    return ops.top_k(vectors(spark, sf_dir), centres(spark, sf_dir).withColumnRenamed("label", "query_id"), 10, threshold=0.35)


@REGISTRY.add("e03_top_k_dot", _WITH + _SCORED.replace(_COS, _DOT) + _RANKED.format(where=""))
def top_k_dot(spark, sf_dir):
    return ops.top_k(vectors(spark, sf_dir), centres(spark, sf_dir).withColumnRenamed("label", "query_id"), 10, metric="dot")


@REGISTRY.add(
    "e04_search_text",
    _WITH + f" SELECT vec_id AS chunk_index, CAST(label AS VARCHAR) AS product_name, round({_COS}(v, m), 6) AS similarity FROM e, mean WHERE label = 3 AND vec_id % 7 <> 0 "
    f"ORDER BY round({_COS}(v, m), 12) DESC, vec_id LIMIT 10",
)
def search_text(spark, sf_dir):
    chunks = vectors(spark, sf_dir).select(
        F.col("label").cast("string").alias("product_name"), F.col("id").alias("chunk_index"), F.when(F.col("id") % 7 != 0, F.col("embedding")).alias("original_embedding")
    )
    return ops.search_text(chunks, mean_vector(spark, sf_dir), 10, "3")


def _benefits(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        F.concat(F.lit("benefit_"), "id").alias("benefit_name"), F.concat(F.lit("product_"), "label").alias("product_name"),
        (F.col("id") % 4 != 0).alias("benefit_exist"), F.col("embedding").alias("original_embedding"), F.col("id").cast("string").alias("original_text"),
    )


@REGISTRY.add(
    "e05_explain_coverage",
    _WITH + f" SELECT 'benefit' AS item_type, 'benefit_' || vec_id AS item_name, 'product_' || label AS product_name, round({_COS}(v, m), 6) AS similarity, CAST(vec_id AS VARCHAR) AS original_text "
    f"FROM e, mean WHERE vec_id % 4 <> 0 ORDER BY round({_COS}(v, m), 12) DESC, item_name LIMIT 5",
)
def explain_coverage(spark, sf_dir):
    return ops.explain_coverage(_benefits(spark, sf_dir), mean_vector(spark, sf_dir))


_LAYERS = ["benefits", "benefit_conditions", "general_conditions"]


def _layer_sql(number: int, name: str) -> str:
    return (
        f"(SELECT '{name}' AS source_table, '{name}_' || vec_id AS item_name, 'product_' || label AS product_name, round({_COS}(v, m), 12) AS s FROM e, mean "
        f"WHERE vec_id % 3 <> {number} ORDER BY s DESC, item_name LIMIT 10)"
    )


@REGISTRY.add(
    "e06_search_layers",
    _WITH + " SELECT source_table, item_name, product_name, round(s, 6) AS similarity FROM (" + " UNION ALL ".join(_layer_sql(i, n) for i, n in enumerate(_LAYERS)) + ")",
)
def search_layers(spark, sf_dir):
    tables = {
        name: vectors(spark, sf_dir).select(
            F.concat(F.lit(f"{name}_"), "id").alias("item_name"), F.concat(F.lit("product_"), "label").alias("product_name"),
            (F.col("id") % 3 != number).alias("exist"), F.col("embedding").alias("normalized_embedding"),
        )
        for number, name in enumerate(_LAYERS)
    }
    return ops.search_layers(mean_vector(spark, sf_dir), tables, 10)


@REGISTRY.add(
    "e07_match_existing",
    _WITH + f", best AS (SELECT vec_id AS id, arg_max(c.label, {_DOT}(v, c.c)) AS name, max({_DOT}(v, c.c)) AS s FROM e, centres AS c(label, c) GROUP BY vec_id) "
    "SELECT id, s >= 0.05 AS is_similar, CASE WHEN s >= 0.05 THEN name END AS matched, round(s, 6) + 0 AS similarity FROM best",
)
def match_existing(spark, sf_dir):
    return ops.match_existing(vectors(spark, sf_dir), centres(spark, sf_dir).withColumnRenamed("label", "name"), 0.05, max_shipped=4, block_rows=100)


_PAIRS = f", pairs AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_COS}(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_COS}(a.v, b.v) > 0.4)"


@REGISTRY.add("e08_near_duplicates", _E + _PAIRS + " SELECT left_id, right_id, round(s, 6) AS similarity FROM pairs")
def near_duplicates(spark, sf_dir):
    # Two levels of pivots, the second distributed.
    return ops.near_duplicates(vectors(spark, sf_dir), 0.4, block_rows=50, max_tree_bytes=0, all_copies=True)


@REGISTRY.add("e08_dedup", _E + _PAIRS + " SELECT vec_id AS id, label FROM e WHERE vec_id NOT IN (SELECT right_id FROM pairs)")
def dedup(spark, sf_dir):
    return ops.dedup(vectors(spark, sf_dir), 0.4, block_rows=50).select("id", "label")


def concepts(spark, sf_dir):
    """Vectors as concepts, visited by id."""
    return vectors(spark, sf_dir).select(F.concat(F.lit("concept_"), "id").alias("name"), F.col("id").alias("pos"), "embedding")


_VISITED = (
    f", near AS (SELECT a.vec_id AS id, b.vec_id AS at_, round({_COS}(a.v, b.v), 12) AS s FROM e a JOIN e b ON b.vec_id < a.vec_id WHERE {_COS}(a.v, b.v) >= 0.35)"
    ", old AS (SELECT id, name, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, name) AS k FROM "
    f"(SELECT vec_id AS id, 'label_' || c.label AS name, round({_COS}(v, c.c), 12) AS s FROM e, centres AS c(label, c))) WHERE k = 1 AND s >= 0.35)"
    ", steps AS (SELECT row_number() OVER (ORDER BY vec_id) AS pos, vec_id, vec_id IN (SELECT id FROM old) AS placed, coalesce(ids, []) AS ids "
    "FROM e LEFT JOIN (SELECT id, list(at_) AS ids FROM near GROUP BY id) n ON n.id = e.vec_id)"
    ", walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS canon UNION ALL SELECT w.pos + 1, "
    "CASE WHEN placed OR len(list_intersect(w.canon, ids)) > 0 THEN w.canon ELSE list_append(w.canon, vec_id) END FROM walk w JOIN steps ON steps.pos = w.pos + 1)"
    ", canon AS (SELECT unnest(canon) AS id FROM walk WHERE pos = (SELECT count(*) FROM e))"
    ", found AS (SELECT id, name, s, 0 AS late, 0 AS at_ FROM old UNION ALL SELECT near.id, 'concept_' || at_, s, 1, at_ FROM near JOIN canon ON canon.id = at_)"
    ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, late, at_) AS k FROM found) WHERE k = 1)"
    " SELECT 'concept_' || vec_id AS name, coalesce(best.name, 'concept_' || vec_id) AS canonical, round(coalesce(s, 1), 6) AS similarity, best.id IS NULL AS is_new FROM e LEFT JOIN best ON best.id = e.vec_id"
)


@REGISTRY.add("e09_canonicalize", _WITH.replace("WITH e", "WITH RECURSIVE e", 1) + _VISITED)
def canonicalize(spark, sf_dir):
    old = centres(spark, sf_dir).select(F.concat(F.lit("label_"), "label").alias("name"), "embedding")
    return ops.canonicalize(concepts(spark, sf_dir), old, 0.35, block_rows=100, max_shipped=4)


def _ann(spark, sf_dir, probes):
    index, middle = ops.ann_index(vectors(spark, sf_dir), lists=20)
    return ops.ann_top_k(cut_lineage(index), middle, centres(spark, sf_dir).withColumnRenamed("label", "query_id"), 10, probes=probes)


@REGISTRY.add("e10_ann_top_k", _WITH + _SCORED + _RANKED.format(where=""))
def ann_top_k(spark, sf_dir):
    """With all lists probed the answer is exact."""
    return _ann(spark, sf_dir, 20)


@REGISTRY.add("e10_ann_recall", "SELECT count(DISTINCT label) AS queries, true AS reaches_floor FROM embeddings")
def ann_recall(spark, sf_dir):
    """With 16 of 20 lists probed, nine tenths of the exact hits are found."""
    share = ops.recall(top_k(spark, sf_dir), _ann(spark, sf_dir, 16))
    return share.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reaches_floor"))


@REGISTRY.add("e10_ann_recall_rows", "SELECT count(*) AS queries, true AS reaches_floor FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall_rows(spark, sf_dir):
    """With the operator's own lists and probes, every row whose id is divisible by 50 finds nine tenths of its exact hits among all rows."""
    rows = vectors(spark, sf_dir)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index, middle = ops.ann_index(rows)
    share = ops.recall(ops.top_k(rows, asked, 10), ops.ann_top_k(cut_lineage(index), middle, asked, 10))
    return share.agg(F.count("*").alias("queries"), (F.min("recall") >= 0.9).alias("reaches_floor"))


@REGISTRY.add("e10_quantized_recall", "SELECT count(*) AS queries, true AS reaches_floor, true AS reads_a_fifth FROM embeddings WHERE vec_id % 50 = 0")
def quantized_recall(spark, sf_dir):
    """Every row whose id is divisible by 50 finds nine tenths of its exact hits among all rows by codes, and at most a fifth of all vectors is read in full."""
    rows = vectors(spark, sf_dir)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = quantized.quantized_index(rows, lists=20)
    index = index._replace(rows=cut_lineage(index.rows))
    share = ops.recall(ops.top_k(rows, asked, 10), quantized.quantized_top_k(index, asked, 10))
    read = quantized.read_share(index, quantized.candidates(index, asked, 100, k=10))
    return share.agg(F.count("*").alias("queries"), (F.min("recall") >= 0.9).alias("reaches_floor")).withColumn("reads_a_fifth", read <= 0.2)


def letter_encoder():
    """A deterministic stand-in for a model: length and two letter counts."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count("t"))] for t in texts]


_LETTERS = "[CAST(length(text) AS DOUBLE), CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE), CAST(length(text) - length(replace(text, 't', '')) AS DOUBLE)]"


@REGISTRY.add(
    "e11_attach_embeddings",
    f"SELECT conv_id, turn, {_LETTERS}[1] AS x, {_LETTERS}[2] AS y, {_LETTERS}[3] AS z FROM conversations",
)
def attach_embeddings(spark, sf_dir):
    encoded = ops.attach_embeddings(table(spark, sf_dir, "conversations"), "text", letter_encoder)
    return encoded.select("conv_id", "turn", *[F.get("embedding", i).alias(c) for i, c in enumerate("xyz")])


@REGISTRY.add(
    "e12_user_search",
    _WITH + f" SELECT vec_id AS id, round({_COS}(v, m), 6) AS similarity FROM e, mean WHERE label = 3 ORDER BY round({_COS}(v, m), 12) DESC, vec_id LIMIT 10",
)
def user_search(spark, sf_dir):
    memories = vectors(spark, sf_dir).withColumnRenamed("label", "user_id")
    return ops.user_search(memories, 3, mean_vector(spark, sf_dir)).select("id", "similarity")


@REGISTRY.add("e12_user_memories", "SELECT vec_id AS id, label AS user_id FROM embeddings WHERE label = 3")
def user_memories(spark, sf_dir):
    return ops.user_memories(vectors(spark, sf_dir).withColumnRenamed("label", "user_id"), 3).select("id", "user_id")


_TERMS = ["the", "and", "que", "der"]
_WORDS = "string_split_regex(lower(text), '[^\\pL\\pN]+')"


@REGISTRY.add(
    "e13_hybrid_search",
    f"WITH s AS (SELECT doc_id AS id, CAST(len(list_intersect(list_distinct({_WORDS}), {_TERMS})) AS DOUBLE) / 4 AS t, coalesce({_COS}({_LETTERS}, [100.0, 10.0, 10.0]), 0) AS c FROM documents), "
    "b AS (SELECT min(t) AS t0, max(t) AS t1, min(c) AS c0, max(c) AS c1 FROM s) "
    "SELECT id, round(score, 6) AS score FROM (SELECT id, round(0.3 * (t - t0) / (t1 - t0) + 0.7 * (c - c0) / (c1 - c0), 12) AS score FROM s, b) ORDER BY score DESC, id LIMIT 10",
)
def hybrid_search(spark, sf_dir):
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.length("text").cast("double"), count("e"), count("t")).alias("embedding"))
    query = F.array(F.lit(100.0), F.lit(10.0), F.lit(10.0))
    # The SQL ranks by the scores that it tells, of six digits.
    return ops.hybrid_search(docs, " ".join(_TERMS), query, digits=6).select("id", "score")


_BM25 = (
    f"d AS (SELECT doc_id AS id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY id, term), "
    "whole AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0), spread AS (SELECT term, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY term), "
    "scored AS (SELECT q, p.id, round(sum(ln(1 + (whole.n - spread.n + 0.5) / (spread.n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d.w) / mean))), 9) AS score "
    "FROM asked JOIN p ON p.term = asked.term JOIN spread ON spread.term = asked.term JOIN d ON d.id = p.id, whole GROUP BY q, p.id)"
)


def text_index(spark, docs):
    """The documents' terms as a table, whose columns keep repeated terms and small numbers short."""
    path = scratch_path(spark, "postings")
    write_table(postings.postings(docs), path)
    return spark.read.parquet(path)


@REGISTRY.add(
    "e13_ranked_text",
    f"WITH asked AS (SELECT DISTINCT q, term FROM (SELECT item_id AS q, unnest({_WORDS}) AS term FROM benchmark) WHERE term <> ''), {_BM25} "
    "SELECT q AS query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10",
)
def ranked_text(spark, sf_dir):
    """Every benchmark item as a query against all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.ranked_text(text_index(spark, docs), queries, 10)


@REGISTRY.add(
    "e13_ranked_hybrid",
    f"WITH asked AS (SELECT 0 AS q, unnest({_TERMS}) AS term), {_BM25}, "
    f"s AS (SELECT doc_id AS id, coalesce(score, 0) AS t, coalesce({_COS}({_LETTERS}, [100.0, 10.0, 10.0]), 0) AS c FROM documents LEFT JOIN scored ON scored.id = doc_id), "
    "b AS (SELECT min(t) AS t0, max(t) AS t1, min(c) AS c0, max(c) AS c1 FROM s) "
    "SELECT id, round(score, 6) AS score FROM (SELECT id, round(0.3 * (t - t0) / (t1 - t0) + 0.7 * (c - c0) / (c1 - c0), 9) AS score FROM s, b) ORDER BY score DESC, id LIMIT 10",
)
def ranked_hybrid(spark, sf_dir):
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.length("text").cast("double"), count("e"), count("t")).alias("embedding"))
    similarity = vec.cosine("embedding", F.array(F.lit(100.0), F.lit(10.0), F.lit(10.0)))
    # The SQL ranks by the scores that it tells, of six digits.
    return postings.text_and_vector(docs, text_index(spark, docs), " ".join(_TERMS), similarity, digits=6).select("id", "score")
