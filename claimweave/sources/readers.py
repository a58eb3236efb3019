"""Readers: claims, page texts, keyed batches, JSON, taxonomies, graphs, files, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.lookups import file_category
from claimweave.functions.text import script_language, text_stats
from claimweave.operators.documents import size_filter

_MONEY = T.DecimalType(10, 2)
CLAIMS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("claim_number", "product_category", "product_name", "claim_status")]
    + [T.StructField(c, T.DateType()) for c in ("accident_date", "report_date", "closed_date")]
    + [T.StructField(c, T.StringType()) for c in ("destination", "claim_type", "cause_of_loss", "loss_type")]
    + [T.StructField(c, _MONEY) for c in ("gross_incurred", "gross_paid", "gross_reserve", "net_incurred", "net_paid", "net_reserve")]
)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """The claims table with its fixed schema; filters and columns reach the scan."""
    return spark.read.schema(CLAIMS_SCHEMA).parquet(path)


def read_claims_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """The claims table from a database, in parallel ranges of a numeric or date column."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLAIMS_SCHEMA.fields])


def _stem(path: str) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def read_page_texts(spark: SparkSession, path: str, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """JSON files, each an array of page texts, as ``source, text_index, text``.

    With ``lines`` every line is such an array; large data should come so, since each file of its
    own costs milliseconds to make and to open. A file or line that is no array of texts gives no rows.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=not lines)
        .select(F.col("_metadata.file_path").alias("_path"), F.from_json("value", "array<string>").alias("_texts"))
    )
    return files.select(_stem("_path").alias("source"), F.posexplode("_texts").alias("text_index", "text"))


def merge_batches(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "id", pattern: str = "*.json") -> DataFrame:
    """Keyed result batches (JSON lines); for the same key the later file by path wins."""
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(path)
    located = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    newest = located.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("_path", "_block")).alias("_r"))
    return newest.select("_r.*")


def concat_json(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON files, each a list or a single object, concatenated. Large data should come as lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(list(paths), multiLine=not lines)


_ITEM = (
    "struct<condition:string,condition_type:string,benefit_name:string,parameters:array<string>,products:map<string,string>>"
)
TAXONOMY_SCHEMA = f"taxonomy_name string, products array<string>, layers map<string,array<{_ITEM}>>, metadata string, _corrupt_record string"


def read_taxonomy(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested taxonomy documents; product records stay JSON text, broken documents show in ``_corrupt_record``."""
    return spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def taxonomy_layer(documents: DataFrame, layer: str) -> DataFrame:
    """The items of one layer in nested form."""
    return documents.select(F.inline(F.col("layers")[layer]))


_NODE = "struct<id:string,memory:string,sources:array<string>,metadata:string>"
_EDGE = "struct<source:string,target:string,type:string,created_at:string>"


def read_graph(spark: SparkSession, path: str, now: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; missing times and edge types get defaults."""
    documents = spark.read.schema(f"nodes array<{_NODE}>, edges array<{_EDGE}>").json(path, multiLine=not lines)
    meta = lambda key: F.get_json_object("metadata", f"$.{key}")
    nodes = documents.select(F.inline("nodes")).select(
        "id",
        F.coalesce("memory", F.lit("")).alias("memory"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.coalesce(meta("created_at"), F.lit(now)).alias("created_at"),
        F.coalesce(meta("updated_at"), F.lit(now)).alias("updated_at"),
    )
    edges = documents.select(F.inline("edges")).select(
        "source", "target", F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce("created_at", F.lit(now)).alias("created_at")
    )
    return nodes, edges


# Categories whose files are read as text.
_TEXTUAL = ["text", "markup", "documentation", "code"]


def _decoded(content: Column) -> Column:
    """Bytes as text with the encoding found: by a byte-order mark, else UTF-8 if they are valid, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    mark = F.hex(F.substring(content, 1, 2))
    return (
        F.when(mark == "FFFE", F.struct(F.decode(F.substring(content, 3, 2147483647), "UTF-16LE").alias("text"), F.lit("utf-16").alias("encoding")))
        .when(mark == "FEFF", F.struct(F.decode(F.substring(content, 3, 2147483647), "UTF-16BE").alias("text"), F.lit("utf-16").alias("encoding")))
        .when(utf8.isNotNull(), F.struct(utf8.alias("text"), F.lit("utf-8").alias("encoding")))
        .otherwise(F.struct(F.decode(content, "ISO-8859-1").alias("text"), F.lit("iso-8859-1").alias("encoding")))
    )


def ingest_files(spark: SparkSession, path: str, max_mb: float = 100, pattern: str = "*") -> DataFrame:
    """Text-like files as rows, with encoding, language and word count; what cannot be read becomes a row with an ``error``.

    Sizes and categories come from the file listing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    typed = files.withColumn("category", file_category("path"))
    too_large = F.col("length") > int(max_mb * 1024 * 1024)
    error = F.when(too_large, "file too large").when(~F.col("category").isin(*_TEXTUAL), F.concat(F.lit("no reader for "), "category"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("text", "string"), ("encoding", "string"), ("language", "string"), ("word_count", "int"))]
    listed = typed.filter(error.isNotNull()).select("path", "category", "length", *none, error.alias("error"))
    readable = size_filter(typed.filter(F.col("category").isin(*_TEXTUAL)), max_mb)
    texts = readable.select("path", "category", "length", _decoded(F.col("content")).alias("_d")).select("path", "category", "length", "_d.*")
    described = texts.withColumns({"language": script_language("text"), "word_count": text_stats("text")["word_count"].cast("int"), "error": F.lit(None).cast("string")})
    return described.select(*listed.columns).unionByName(listed)


def csv_text(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """CSV or TSV rows as tab-joined lines, and the row and column counts."""
    rows = spark.read.csv(path, sep=sep, header=False, quote='"', escape='"')
    cells = [F.coalesce(F.col(c), F.lit("")) for c in rows.columns]
    lines = rows.select(F.concat_ws("\t", *cells).alias("line"))
    return lines, rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(rows.columns)).cast("bigint").alias("col_count"))
