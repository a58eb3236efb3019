"""Concept graph: growth from proposals, fact linking, question/answer assembly.

A graph is three DataFrames. Edges are stored in both directions; every step
returns a new graph and leaves the old one as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import variants
from claimweave.functions.text import strip
from claimweave.operators.vectors import canonicalize, top_k
from claimweave.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """``nodes(name, embedding)``, ``edges(src, dst)``, ``mapping(alias, canonical)``."""

    nodes: DataFrame
    edges: DataFrame
    mapping: DataFrame

    def pinned(self) -> "Graph":
        return Graph(cut_lineage(self.nodes), cut_lineage(self.edges), cut_lineage(self.mapping))


Embed = Callable[[DataFrame], DataFrame]
"""Adds an ``embedding`` column to a frame of ``name``s."""


# --- collecting ----------------------------------------------------------------


def seed_nodes(texts: DataFrame, column: str = "concept") -> DataFrame:
    """Trimmed distinct non-blank concepts, each mapped to itself."""
    names = texts.select(strip(column).alias("name")).filter("name <> ''").distinct()
    return names.select("name", F.col("name").alias("canonical"))


def collect_concepts(extracted: DataFrame) -> DataFrame:
    """Sorted distinct concepts of the successful extractions."""
    return extracted.filter(F.col("status") == "success").select(F.explode("concepts").alias("concept")).distinct().orderBy("concept")


def collect_facts(extracted: DataFrame, product: str = "product_name", order: str = "text_index") -> DataFrame:
    """Distinct facts per product with the place each was first seen; sort by it for the original order.

    The rows of all products together keep repeats across products.
    """
    facts = extracted.filter(F.col("status") == "success").select(product, order, F.posexplode("facts").alias("fact_index", "fact"))
    first = facts.groupBy(product, "fact").agg(F.min(F.struct(order, "fact_index")).alias("_p"))
    return first.select(product, "fact", F.col("_p")[order].alias("first_text"), F.col("_p.fact_index").alias("first_index"))


# --- growth --------------------------------------------------------------------


def _proposed(proposals: DataFrame) -> DataFrame:
    """One row per proposed concept of a successful expansion, as proposed."""
    return proposals.filter(F.col("status") == "success").select(F.col("center_concept").alias("center"), F.explode("new_concepts").alias("raw"))


def expand(graph: Graph, proposals: DataFrame, threshold: float, embed: Embed, **limits: int) -> tuple[Graph, DataFrame]:
    """Adds proposed neighbours; returns the new graph and a one-row statistic.

    A known name goes through the mapping; an unknown one is compared by vector,
    in name order, and either mapped or added. Only unknown names are embedded.
    Every occurrence of a known alias counts as a duplicate, a new alias counts
    once. Self-edges are left out. ``limits`` are those of ``canonicalize``.
    """
    named = _proposed(proposals).select("center", strip("raw").alias("name")).filter("name <> ''")
    counted = named.groupBy("name", "center").agg(F.count(F.lit(1)).alias("_n"))
    known = counted.join(graph.mapping.withColumnRenamed("alias", "name"), "name", "left")
    known = cut_lineage(known)
    unknown = known.filter("canonical IS NULL").select("name").distinct()
    vectors = cut_lineage(embed(unknown))
    # A round that proposes only known names compares nothing.
    if vectors.isEmpty():
        placed = vectors.select("name", F.col("name").alias("canonical"), F.lit(1.0).alias("similarity"), F.lit(True).alias("is_new"))
    else:
        placed = cut_lineage(canonicalize(vectors.select("name", F.col("name").alias("pos"), "embedding"), graph.nodes, threshold, **limits))

    added = vectors.join(placed.filter("is_new").select("name"), "name", "left_semi").select("name", "embedding")
    nodes = graph.nodes.select("name", "embedding").unionByName(added)
    mapping = graph.mapping.unionByName(placed.select(F.col("name").alias("alias"), "canonical"))

    targets = known.join(placed.select("name", F.col("canonical").alias("_c")), "name", "left").select(
        "center", F.coalesce("canonical", "_c").alias("target")
    )
    targets = targets.filter(F.col("center") != F.col("target")).join(nodes.select(F.col("name").alias("center")), "center", "left_semi")
    both = targets.select(F.col("center").alias("src"), F.col("target").alias("dst")).union(targets.select("target", "center")).distinct()
    fresh = cut_lineage(both.join(graph.edges, ["src", "dst"], "left_anti"))
    edges = graph.edges.select("src", "dst").unionByName(fresh)

    per_occurrence = known.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("proposals"),
        F.coalesce(F.sum(F.when(F.col("canonical") != F.col("name"), F.col("_n"))), F.lit(0)).alias("_known"),
    )
    per_name = placed.agg(F.count_if("is_new").alias("nodes_added"), F.count_if(~F.col("is_new")).alias("_aliases"))
    stats = per_occurrence.select(
        "proposals",
        per_name.select("nodes_added").scalar().alias("nodes_added"),
        F.floor(fresh.agg(F.count(F.lit(1))).scalar() / 2).alias("edges_added"),
        (F.col("_known") + per_name.select("_aliases").scalar()).alias("duplicates"),
    ).withColumn("add_rate", F.coalesce(F.try_divide(F.col("nodes_added").cast("double"), F.col("proposals").cast("double")), F.lit(0.0)))
    return Graph(nodes, edges, mapping), stats


def connectivity(graph: Graph, proposals: DataFrame) -> DataFrame:
    """New edges between old nodes over old undirected edges, by exact name and occurrence.

    Infinite while the graph has no edges, 0 when nothing was proposed.
    """
    named = _proposed(proposals).groupBy("center", "raw").agg(F.count(F.lit(1)).alias("_n"))
    total = named.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    between = (
        named.filter(F.col("center") != F.col("raw"))
        .join(graph.nodes.select(F.col("name").alias("raw")), "raw", "left_semi")
        .join(graph.edges.select(F.col("src").alias("center"), F.col("dst").alias("raw")), ["center", "raw"], "left_anti")
    )
    counts = between.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("new_edges")).select(
        "new_edges", F.floor(graph.edges.agg(F.count(F.lit(1))).scalar() / 2).alias("old_edges"), total.alias("_total")
    )
    rate = (
        F.when(F.col("_total") == 0, 0.0)
        .when(F.col("old_edges") == 0, float("inf"))
        .otherwise(F.try_divide(F.col("new_edges").cast("double"), F.col("old_edges").cast("double")))
    )
    return counts.select("new_edges", "old_edges", rate.alias("connectivity_rate"))


def grow(
    graph: Graph,
    propose: Callable[[Graph], DataFrame],
    embed: Embed,
    threshold: float = 0.8,
    max_rounds: int = 10,
    min_add_rate: float = 0.05,
    min_connectivity: float = 0.2,
    **limits: int,
) -> tuple[DataFrame, list[Graph]]:
    """Expands until a rate falls below its threshold; returns one row per round and every round's graph.

    Each round is pinned by a reliable checkpoint, so earlier rounds are never recomputed.
    """
    spark = graph.nodes.sparkSession
    rounds, history = [], []
    for number in range(1, max_rounds + 1):
        proposals = cut_lineage(propose(graph))
        links = connectivity(graph, proposals).first()
        grown, stats = expand(graph, proposals, threshold, embed, **limits)
        numbers = stats.first()
        skipped = proposals.filter((F.col("status") == "success") & (F.size("new_concepts") == 0)).count()
        graph = grown.pinned()
        history.append(graph)
        size = graph_counts(graph).first()
        rounds.append(
            (number, numbers["nodes_added"], numbers["edges_added"], numbers["duplicates"], skipped, size["nodes"], size["edges"],
             numbers["add_rate"], links["connectivity_rate"])
        )
        if numbers["add_rate"] < min_add_rate or links["connectivity_rate"] < min_connectivity:
            break
    schema = (
        "round int, nodes_added bigint, edges_added bigint, duplicates bigint, skipped bigint, nodes bigint, edges bigint, "
        "add_rate double, connectivity_rate double"
    )
    return spark.createDataFrame(rounds, schema), history


def graph_counts(graph: Graph) -> DataFrame:
    """Nodes and undirected edges."""
    edges = graph.edges.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    return graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).select("nodes", edges.alias("edges"))


def add_products(graph: Graph, names: DataFrame, column: str = "product_name") -> Graph:
    """Adds product names that are not nodes yet; they carry no vector."""
    wanted = names.select(F.col(column).alias("name")).distinct().join(graph.nodes, "name", "left_anti")
    nodes = graph.nodes.select("name", "embedding").unionByName(wanted, allowMissingColumns=True)
    return Graph(nodes, graph.edges, graph.mapping)


def link_facts(graph: Graph, facts: DataFrame, k: int = 5, **limits: int) -> Graph:
    """Joins each fact ``(name, embedding)`` to its ``k`` nearest nodes by dot product, both ways.

    Facts are matched against the nodes as they were, never against each other. ``limits`` are those of ``top_k``.
    """
    nearest = cut_lineage(top_k(graph.nodes, facts, k, "name", "embedding", "name", "embedding", metric="dot", **limits).select("name", F.col("id").alias("node")))
    nearest = nearest.filter(F.col("name") != F.col("node"))
    links = nearest.select(F.col("name").alias("src"), F.col("node").alias("dst")).union(nearest.select("node", "name"))
    fresh = facts.select("name", "embedding").dropDuplicates(["name"]).join(graph.nodes, "name", "left_anti")
    return Graph(graph.nodes.select("name", "embedding").unionByName(fresh), graph.edges.select("src", "dst").unionByName(links).distinct(), graph.mapping)


def unique_edges(graph: Graph) -> DataFrame:
    """Undirected distinct pairs whose two ends are both nodes."""
    pairs = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = graph.nodes.select("name")
    return pairs.join(ends.withColumnRenamed("name", "a"), "a", "left_semi").join(ends.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b")


# --- questions and answers -----------------------------------------------------

_TEXT_FIELDS = ["question", "reasoning_guidance", "final_answer", "best_to_know"]


def _field(item: Column, name: str) -> Column:
    default = F.array().cast("array<string>") if name == "knowledge_facts" else F.lit("")
    return F.coalesce(item[name], default).alias(name)


def kept_pairs(judged: DataFrame) -> DataFrame:
    """Judged pairs that are relevant and meaningful and have a question, with defaults filled in.

    ``judged``: ``id, concepts, is_relevant, is_meaningful, question struct<...>``.
    """
    kept = judged.filter(F.coalesce("is_relevant", F.lit(False)) & F.coalesce("is_meaningful", F.lit(False)) & F.col("question").isNotNull())
    fields = ["question", "reasoning_guidance", "knowledge_facts", "final_answer", "best_to_know"]
    return kept.select("id", "concepts", *[_field(F.col("question"), f) for f in fields])


def to_qa(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions of successful results as rows, and the conversion counts.

    ``results``: ``status, id, concepts, questions array<struct<...>>``; one concept
    is a single item, two a pair. Questions without question or answer text are
    dropped and counted as failed.
    """
    has_concept = F.coalesce(F.size("concepts") > 0, F.lit(False))
    questions = F.coalesce(F.size("questions"), F.lit(0))
    success = F.coalesce(F.col("status") == "success", F.lit(False))
    usable = success & has_concept & (questions > 0)
    filled = lambda q: (F.coalesce(q["question"], F.lit("")) != "") & (F.coalesce(q["final_answer"], F.lit("")) != "")
    rows = results.filter(usable).select("id", "concepts", F.posexplode("questions").alias("question_index", "_q")).filter(filled(F.col("_q")))
    fields = ["question", "reasoning_guidance", "knowledge_facts", "final_answer", "best_to_know"]
    qa = rows.select("id", "question_index", "concepts", *[_field(F.col("_q"), f) for f in fields])
    good = F.size(F.filter("questions", filled))
    single = F.size("concepts") == 1

    def total(condition: Column, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("bigint")

    counts = results.agg(
        F.count(F.lit(1)).alias("processed"),
        total(usable, good).alias("generated"),
        F.count_if(usable).alias("converted"),
        (F.count_if(~success) + total(usable, questions - good)).alias("failed"),
        F.count_if(success & ~(has_concept & (questions > 0))).alias("skipped"),
        total(success & has_concept & single, questions).alias("single_items"),
        F.count_if(success & has_concept & ~single).alias("pair_items"),
    )
    return qa, counts


def merge_qa(*collections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, collections)


def qa_with_hint(qa: DataFrame) -> DataFrame:
    return qa.filter(strip(F.coalesce("best_to_know", F.lit(""))) != "")


def check_qa(items: DataFrame, item: str = "item") -> DataFrame:
    """Required fields and types over a JSON column; adds ``errors`` and ``has_hint``."""
    body = variants.members(variants.parse(item))
    required = ["concept", "question", "reasoning_guidance", "knowledge_facts", "final_answer", "best_to_know"]
    kinds = {"concept": ["string", "array"], "knowledge_facts": ["array"], "best_to_know": ["string"]}
    checked = items.withColumn("_f", body)
    fields = F.col("_f")
    has = lambda key: F.array_contains(F.map_keys(fields), key)
    tests = [F.when(fields.isNull(), F.lit("item: not an object"))]
    tests += [F.when(~has(key), F.lit(f"missing {key}")) for key in required]
    tests += [F.when(has(key) & ~F.coalesce(variants.kind(fields[key]).isin(allowed), F.lit(False)), F.lit(f"{key}: wrong type")) for key, allowed in kinds.items()]
    errors = F.array_compact(F.array(*tests))
    hint = strip(F.coalesce(F.try_variant_get(fields["best_to_know"], "$", "string"), F.lit(""))) != ""
    return checked.withColumn("errors", errors).withColumn("has_hint", (F.size("errors") == 0) & hint).drop("_f")


def check_qa_counts(checked: DataFrame) -> DataFrame:
    valid = F.size("errors") == 0
    return checked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if("has_hint").alias("with_hint")
    )


def concept_nodes(qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct concepts of single and pair items as nodes, and the items with another arity."""
    arity = F.coalesce(F.size("concepts"), F.lit(0))
    names = qa.filter(arity.isin(1, 2)).select(F.explode("concepts").alias("memory")).distinct()
    nodes = names.select(
        F.sha2("memory", 256).alias("id"), F.lit("concept").alias("kind"), "memory", F.array("memory").alias("entities")
    )
    return nodes, qa.filter(~arity.isin(1, 2)).withColumn("arity", arity)


def qa_nodes(qa: DataFrame, concepts: DataFrame) -> DataFrame:
    """Question nodes with formatted text, kind and related concept ids.

    Items of another arity, and items with a concept that is no node, are left out.
    """
    pair = F.size("concepts") == 2
    ids = concepts.select("id", "memory")
    first = ids.select(F.col("memory").alias("_m0"), F.col("id").alias("_c0"))
    second = ids.select(F.col("memory").alias("_m1"), F.col("id").alias("_c1"))
    joined = (
        qa.filter(F.size("concepts").isin(1, 2))
        .join(first, F.col("concepts")[0] == F.col("_m0"))
        .join(second, F.get("concepts", 1) == F.col("_m1"), "left")
        .filter(~pair | F.col("_c1").isNotNull())
    )
    memory = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), "question"),
        F.concat(F.lit("Reasoning Guidance: "), "reasoning_guidance"),
        F.concat(F.lit("Knowledge Facts: "), F.array_join("knowledge_facts", "; ")),
        F.concat(F.lit("Answer: "), "final_answer"),
        F.concat(F.lit("Best to Know: "), F.coalesce("best_to_know", F.lit(""))),
    )
    return joined.select(
        F.sha2(F.concat_ws("|", F.lit("qa"), F.col("id").cast("string"), F.col("question_index").cast("string")), 256).alias("id"),
        F.when(pair, "relation_qa").otherwise("concept_qa").alias("kind"),
        memory.alias("memory"),
        F.col("concepts").alias("entities"),
        F.when(pair, F.array("_c0", "_c1")).otherwise(F.array("_c0")).alias("related"),
    )


def qa_edges(nodes: DataFrame) -> DataFrame:
    """One RELATE_TO per concept pair, and a PARENT edge from every concept to its question."""
    related = nodes.filter(F.col("kind") == "relation_qa").select(
        F.when(F.get("entities", 0) <= F.get("entities", 1), F.get("related", 0)).otherwise(F.get("related", 1)).alias("source"),
        F.when(F.get("entities", 0) <= F.get("entities", 1), F.get("related", 1)).otherwise(F.get("related", 0)).alias("target"),
    )
    parents = nodes.select(F.explode("related").alias("source"), F.col("id").alias("target"), F.lit("PARENT").alias("type"))
    return related.distinct().withColumn("type", F.lit("RELATE_TO")).unionByName(parents)


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends present, once each, under their own type."""
    ids = nodes.select("id")
    return (
        edges.dropDuplicates(["source", "target", "type"])
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node kind and by edge type, and both totals: ``part, label, n``."""

    def counted(df: DataFrame, part: str, column: str) -> DataFrame:
        by_label = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        total = by_label.agg(F.lit("total").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
        return by_label.unionByName(total).select(F.lit(part).alias("part"), "label", "n")

    return counted(nodes, "nodes", "kind").unionByName(counted(edges, "edges", "type"))


def batch_stats(results: DataFrame, batch: str = "batch_id", items: str = "items") -> DataFrame:
    """Success, failure, rate, items and empty results per batch."""
    success = F.coalesce(F.col("status") == "success", F.lit(False))
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"),
        (F.count_if(success) / F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.sum(F.when(success, F.coalesce(F.size(items), F.lit(0)))), F.lit(0)).cast("bigint").alias("items"),
        F.count_if(success & (F.size(items) == 0)).alias("skipped"),
    )
