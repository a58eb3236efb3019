"""Readers and writers, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.plans.claims_queries import _ALL_SQL, _sql
from claimweave.plans.registry import Registry
from claimweave.plans.tables import claims_view, table
from claimweave.plans.taxonomy_queries import _layers
from claimweave.plans.taxonomy_tables import taxonomy_sql
from claimweave.plans.text_queries import _CHARS, _filled
from claimweave.session import scratch_path
from claimweave.sources import readers, writers

REGISTRY = Registry.empty()
NOW = "2024-06-01T00:00:00"


@REGISTRY.add("a01_read_claims", _sql(f"SELECT {_ALL_SQL} FROM claims"))
def read_claims(spark, sf_dir):
    path = scratch_path(spark, "claims")
    writers.write_table(claims_view(spark, sf_dir), path)
    return readers.read_claims(spark, path)


@REGISTRY.add("a02_read_page_texts", "SELECT conv_id, true AS named_by_file, turn AS text_index, text FROM conversations")
def read_page_texts(spark, sf_dir):
    """One JSON array per conversation: every fiftieth conversation is a file, the others are lines of larger files. The reader's source is the file's name without its ending."""
    path = scratch_path(spark, "page_texts")
    # Each text is headed by its conversation; a header alone is a NULL text.
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\t", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "text").alias("text"))))
    documents = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(turns, lambda t: t["text"])).alias("value"))
    alone = F.coalesce(F.col("conv_id") % 50 == 0, F.lit(False))
    documents.where(alone).select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    documents.where(~alone).select("value").write.text(f"{path}/lines")

    def read(folder: str, lines: bool):
        # The writer chooses the files' names.
        named = (F.length("source") > 0) & (F.concat(F.col("source"), F.lit(".txt")) == F.substring_index(F.input_file_name(), "/", -1))
        return readers.read_page_texts(spark, f"{path}/{folder}", "*.txt", lines).select(
            F.substring_index("text", "\t", 1).try_cast("bigint").alias("conv_id"),
            named.alias("named_by_file"),
            "text_index",
            F.when(F.instr("text", "\t") > 0, F.expr("substring(text, instr(text, '\t') + 1)")).alias("text"),
        )

    return read("files", False).unionByName(read("lines", True))


@REGISTRY.add("a03_merge_batches", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS result FROM orders")
def merge_batches(spark, sf_dir):
    path = scratch_path(spark, "batches")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    orders.withColumn("result", F.lit("first")).write.json(f"{path}/batch_1")
    orders.filter("id % 3 = 0").withColumn("result", F.lit("second")).write.json(f"{path}/batch_2")
    return readers.merge_batches(spark, path, "id bigint, result string")


@REGISTRY.add("a04_concat_json", "SELECT c_custkey AS id, c_mktsegment AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concat_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")).write.json(f"{path}/a")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.json(f"{path}/b")
    return readers.concat_json(spark, [f"{path}/a", f"{path}/b"], "id bigint, name string", lines=True)


@REGISTRY.add("a05_read_taxonomy", taxonomy_sql() + "SELECT condition_name AS condition, min(condition_type) AS condition_type, count(*) AS products FROM gc GROUP BY condition_name")
def read_taxonomy(spark, sf_dir):
    path = scratch_path(spark, "taxonomy")
    layer = _layers(spark, sf_dir)["layer_1_general_conditions"]
    # Product records are nested JSON, so they are spliced in as text. One item per condition name.
    records = F.array_join(F.transform(F.map_entries("products"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    kind = F.coalesce(F.concat(F.lit('"'), "condition_type", F.lit('"')), F.lit("null"))
    item = F.concat(F.lit('{"condition":"'), "condition", F.lit('","condition_type":'), kind, F.lit(',"products":{'), records, F.lit("}}"))
    document = layer.agg(
        F.concat(F.lit('{"taxonomy_name":"t","products":[],"layers":{"layer_1_general_conditions":['), F.array_join(F.collect_list(item), ","), F.lit("]}}")).alias("value")
    )
    document.write.text(path)
    items = readers.taxonomy_layer(readers.read_taxonomy(spark, path), "layer_1_general_conditions")
    return items.select("condition", "condition_type", F.size("products").alias("products"))


def _graph_files(spark, sf_dir):
    path = scratch_path(spark, "graph")
    n = F.col("vec_id")
    node = F.struct(
        F.concat(F.lit("n"), n).alias("id"), F.when(n % 3 != 0, F.concat(F.lit("memory "), n)).alias("memory"),
        F.struct(F.when(n % 2 == 0, "2023-01-01T00:00:00").alias("created_at"), F.col("label")).alias("metadata"),
    )
    edge = F.struct(F.concat(F.lit("n"), n).alias("source"), F.concat(F.lit("n"), n + 1).alias("target"), F.when(n % 2 == 0, "PARENT").alias("type"))
    table(spark, sf_dir, "embeddings").select(F.array(node).alias("nodes"), F.array(edge).alias("edges")).write.json(path)
    return readers.read_graph(spark, path, NOW, lines=True)


@REGISTRY.add(
    "a06_read_graph_nodes",
    f"SELECT 'n' || vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN 'memory ' || vec_id ELSE '' END AS memory, CASE WHEN vec_id % 2 = 0 THEN '2023-01-01T00:00:00' ELSE '{NOW}' END AS created_at, '{NOW}' AS updated_at FROM embeddings",
)
def read_graph_nodes(spark, sf_dir):
    return _graph_files(spark, sf_dir)[0].select("id", "memory", "created_at", "updated_at")


@REGISTRY.add(
    "a06_read_graph_edges",
    f"SELECT 'n' || vec_id AS source, 'n' || (vec_id + 1) AS target, CASE WHEN vec_id % 2 = 0 THEN 'PARENT' ELSE 'RELATED_TO' END AS type, '{NOW}' AS created_at FROM embeddings",
)
def read_graph_edges(spark, sf_dir):
    return _graph_files(spark, sf_dir)[1]


_UPSERTED = (
    "WITH src AS (SELECT k, arg_max(name, o) AS name, arg_max(amount, o) AS amount FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS k, o_orderpriority AS name, o_totalprice AS amount, o_orderkey AS o FROM orders) GROUP BY k) "
    "SELECT coalesce(k, c_custkey) AS id, CASE WHEN k IS NULL THEN c_mktsegment ELSE name END AS name, round(CASE WHEN k IS NULL THEN c_acctbal ELSE amount END, 6) AS amount, "
    "CASE WHEN c_custkey IS NULL THEN 'now' ELSE 'before' END AS created_at, CASE WHEN k IS NULL THEN 'before' ELSE 'now' END AS updated_at FROM customer FULL OUTER JOIN src ON k = c_custkey"
)


def _upserted(spark, sf_dir):
    """Customers as the target, and orders as the source; some keys are new."""
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("amount"), F.lit("before").alias("created_at"), F.lit("before").alias("updated_at")
    )
    moved = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey"))
    source = table(spark, sf_dir, "orders").select(moved.alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    return target, source


@REGISTRY.add("a07_upsert", _UPSERTED)
def upsert(spark, sf_dir):
    target, source = _upserted(spark, sf_dir)
    return writers.upsert(target, source, ["id"], "seq", F.lit("now"))


@REGISTRY.add("a07_upsert_in_place", _UPSERTED)
def upsert_in_place(spark, sf_dir):
    """The same in a table cut by ranges of the key."""
    target, source = _upserted(spark, sf_dir)
    part, path = F.expr("id div 100"), scratch_path(spark, "upserted")
    target.withColumn("part", part).write.partitionBy("part").parquet(path)
    writers.upsert_in_place(spark, path, source, ["id"], "seq", F.lit("now"), part)
    return spark.read.parquet(path).drop("part")


@REGISTRY.add(
    "a08_ingest_files",
    f"SELECT 'text' AS category, 'utf-8' AS encoding, CAST(sum(length(html) + 1) AS BIGINT) AS characters, CAST(sum({_filled(f'string_split_regex(html, {chr(39)}[{_CHARS}]+{chr(39)})')}) AS BIGINT) AS words, CAST(0 AS BIGINT) AS errors FROM pages "
    "UNION ALL SELECT 'spreadsheet', NULL, NULL, NULL, CAST(1 AS BIGINT)",
)
def ingest_files(spark, sf_dir):
    """Pages as text files, and suppliers as a CSV file that has no text reader."""
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "pages").select("html").write.text(f"{path}/pages")
    table(spark, sf_dir, "supplier").coalesce(1).write.csv(f"{path}/suppliers")
    files = readers.ingest_files(spark, path, pattern="part-*")
    return files.groupBy("category", "encoding").agg(
        F.sum(F.length("text")).cast("bigint").alias("characters"), F.sum("word_count").cast("bigint").alias("words"), F.count("error").alias("errors")
    )


def _csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('a "b", '), "c_mktsegment").alias("t"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n"))
    rows.write.csv(path, escape='"')
    return readers.csv_text(spark, path)


@REGISTRY.add("a09_csv_lines", "SELECT c_custkey || chr(9) || 'a \"b\", ' || c_mktsegment || chr(9) || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS line FROM customer")
def csv_lines(spark, sf_dir):
    return _csv(spark, sf_dir)[0]


@REGISTRY.add("a09_csv_counts", "SELECT count(*) AS row_count, CAST(3 AS BIGINT) AS col_count FROM customer")
def csv_counts(spark, sf_dir):
    return _csv(spark, sf_dir)[1]


@REGISTRY.add("a10_write_table", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def write_table(spark, sf_dir):
    path = scratch_path(spark, "events")
    writers.write_table(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, ["event_type"])
    written = spark.read.parquet(path)
    return written.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
