"""Document jobs: chunking, page assembly, OCR confidences, samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.ordered import dense_ids
from claimweave.functions.text import sentences, strip, strip_end


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk_bounds(lengths: Column, size: int, overlap: int) -> Column:
    """The runs of sentences that make up a document's chunks, as structs ``begin`` and ``end``.

    ``lengths`` holds the sentences' lengths. Walking over them keeps the begin of the open chunk,
    where its own sentences start after those repeated from the chunk before (``fresh``), and two
    lengths: of the repeated part, which counts as one piece with its blanks, and of the whole. A
    chunk closes before the sentence that would exceed ``size``. The next one begins with the
    longest run of whole pieces at its end that fits into ``overlap``.
    """
    begin, fresh, head, used = (F.lit(0).alias(n) for n in ("begin", "fresh", "head", "used"))
    start = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), begin, fresh, head, used)

    def walk(lens: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            own = F.get(lens, i)

            def fit(last: Column) -> Column:
                """How many of the chunk's own sentences, from its end, fit into the overlap, and their length."""
                return F.aggregate(
                    last,
                    F.struct(F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit(True).alias("open")),
                    lambda f, x: F.when(f["open"] & (f["length"] + x <= overlap), F.struct((f["n"] + 1).alias("n"), (f["length"] + x).alias("length"), F.lit(True).alias("open"))).otherwise(
                        F.struct(f["n"].alias("n"), f["length"].alias("length"), F.lit(False).alias("open"))
                    ),
                )

            def close(f: Column) -> Column:
                everything = f["open"] & (state["fresh"] > state["begin"]) & (f["length"] + state["head"] <= overlap)
                at = F.when(everything, state["begin"]).otherwise(i - f["n"])
                length = F.when(everything, state["head"]).otherwise(F.lit(0)) + f["length"] + F.greatest(F.when(everything, f["n"]).otherwise(f["n"] - 1), F.lit(0))
                done = F.concat(state["done"], F.array(F.struct(state["begin"].alias("begin"), i.alias("end"))))
                return F.struct(done.alias("done"), at.alias("begin"), i.alias("fresh"), length.alias("head"), (length + own).alias("used"))

            grown = F.struct(state["done"].alias("done"), state["begin"].alias("begin"), state["fresh"].alias("fresh"), state["head"].alias("head"), (state["used"] + own).alias("used"))
            closed = _let(fit(F.reverse(F.slice(lens, state["fresh"] + 1, i - state["fresh"]))), close)
            return F.when((state["begin"] < i) & (state["used"] + own > size), closed).otherwise(grown)

        def last(state: Column) -> Column:
            return F.concat(state["done"], F.array(F.struct(state["begin"].alias("begin"), F.size(lens).alias("end"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(lens) - 1), start, step, last)

    return F.when(F.size(lengths) > 0, _let(lengths, walk))


def chunk(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    size: int = 1000,
    overlap: int = 200,
    minimum: int = 100,
    metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Sentence-aware chunks of each document, one row per chunk.

    The length of a chunk counts its sentences without the blanks between them. Chunks under
    ``minimum`` characters are dropped and take no index. Column functions only, and no shuffle.
    """

    def cut(units: Column) -> Column:
        bounds = chunk_bounds(F.transform(units, F.length), size, overlap)
        texts = F.transform(bounds, lambda b: F.array_join(F.slice(units, b["begin"] + 1, b["end"] - b["begin"]), " "))
        return F.filter(texts, lambda t: F.length(t) >= minimum)

    chunks = df.select(*keys, F.posexplode(_let(sentences(text), cut)).alias("chunk_index", "text")).withColumn("char_count", F.length("text"))
    if metadata is not None:
        entries = [F.lit(part) for item in metadata.items() for part in item]
        chunks = chunks.withColumn("metadata", F.create_map(*entries))
    return chunks


def _part(order: str, per_part: int) -> Column:
    return F.floor(F.col(order) / F.lit(per_part)).cast("bigint")


def _ordered(order: str, value: Column) -> Column:
    """One group's values in order, NULLs kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def join_sections(df: DataFrame, doc: str, order: str, text: str, per_part: int = 1000) -> DataFrame:
    """Non-blank sections of a document joined by a blank line.

    ``order`` counts sections from 0. ``part`` numbers runs of ``per_part``
    sections: a usual document is one row, a huge one several, each of which
    starts with the separator, so that the parts concatenate to the whole.
    """
    filled = df.filter(strip(text) != "").withColumn("part", _part(order, per_part))
    joined = filled.groupBy(doc, "part").agg(F.array_join(_ordered(order, F.col(text)), "\n\n").alias("text"))
    first = F.row_number().over(Window.partitionBy(doc).orderBy("part")) == 1
    return joined.withColumn("text", F.when(first, F.col("text")).otherwise(F.concat(F.lit("\n\n"), "text")))


def assemble_pages(
    df: DataFrame, doc: str, page: str = "page", text: str = "markdown", prefix: str = "", per_part: int = 1000
) -> DataFrame:
    """Pages in order under a title and page headings; image links point to page folders.

    Pages are numbered from 0. A document of up to ``per_part`` pages is one row;
    a longer one comes in parts that concatenate to the whole.
    """
    folder = F.concat(F.lit(f"]({prefix}page-"), F.lpad(F.col(page).cast("string"), 3, "0"), F.lit("/images/"))
    # Page numbers of more than three digits keep all of them.
    folder = F.when(F.col(page) >= 1000, F.concat(F.lit(f"]({prefix}page-"), F.col(page).cast("string"), F.lit("/images/"))).otherwise(folder)
    linked = F.regexp_replace(F.col(text), F.lit(r"\]\((?:\./)?images/(?=[^)]+\))"), F.regexp_replace(folder, r"([\\$])", r"\\$1"))
    piece = F.concat(F.lit("\n---\n\n\n## Page "), (F.col(page) + 1).cast("string"), F.lit("\n\n"), strip(linked), F.lit("\n"))
    parts = (
        df.withColumn("part", _part(page, per_part))
        .groupBy(doc, "part")
        .agg(F.array_join(_ordered(page, piece), "").alias("_body"))
    )
    order = Window.partitionBy(doc).orderBy("part")
    titled = F.when(F.row_number().over(order) == 1, F.concat(F.lit("# "), F.col(doc).cast("string"), "_body")).otherwise(F.col("_body"))
    last = F.lead("part").over(order).isNull()
    return parts.select(
        doc, "part", titled.alias("_text"), last.alias("_last")
    ).select(doc, "part", F.when(F.col("_last"), F.concat(strip_end("_text"), F.lit("\n"))).otherwise(F.col("_text")).alias("text"))


def page_array(df: DataFrame, doc: str, page: str = "page", text: str = "text", per_part: int = 1000) -> DataFrame:
    """Ordered page texts per document, the empty string for a missing page.

    Documents of more than ``per_part`` pages come in several parts.
    """
    last = df.groupBy(doc).agg(F.max(page).alias("_last"))
    slots = last.select(doc, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last").cast("bigint"))).alias(page))
    return (
        slots.join(df.select(doc, F.col(page).cast("bigint").alias(page), text), [doc, page], "left")
        .withColumn("part", _part(page, per_part))
        .groupBy(doc, "part")
        .agg(_ordered(page, F.coalesce(F.col(text), F.lit(""))).alias("pages"))
    )


def page_confidence(
    lines: DataFrame, keys: Sequence[str] = ("doc", "page"), line: str = "line_no", text: str = "text", confidence: str = "confidence", per_part: int = 10_000
) -> DataFrame:
    """Recognised lines joined per page, with the page's average confidence.

    A page of more than ``per_part`` lines comes in several parts, all with the
    page's average.
    """
    parts = (
        lines.withColumn("part", _part(line, per_part))
        .groupBy(*keys, "part")
        .agg(
            F.array_join(_ordered(line, F.col(text)), "\n").alias("text"),
            F.sum(F.col(confidence).cast("double")).alias("_sum"),
            F.count(confidence).alias("_n"),
        )
    )
    page = Window.partitionBy(*keys)
    average = F.coalesce(F.try_divide(F.sum("_sum").over(page), F.sum("_n").over(page).cast("double")), F.lit(0.0))
    return parts.withColumn("average_confidence", average).drop("_sum", "_n")


def size_filter(files: DataFrame, megabytes: float, length: str = "length") -> DataFrame:
    """Files up to the size limit."""
    return files.filter(F.col(length) <= int(megabytes * 1024 * 1024))


def sample_positions(df: DataFrame, doc: str, index: str = "text_index") -> DataFrame:
    """First, middle and last text of each document by ``index``; all of them when there are fewer than three.

    Positions count the rows of a document in order, so gaps in the index do not matter. The
    rows are numbered over range partitions; even a huge document spans many tasks.
    """
    numbered = dense_ids(df.select(doc, index), [doc, index], "_at", start=0)
    ends = numbered.groupBy(doc).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    place = F.col("_at") - F.col("_first")
    wanted = numbered.join(ends, doc).filter((F.col("_n") < 3) | place.isin(0) | (place == F.floor(F.col("_n") / 2)) | (place == F.col("_n") - 1))
    return df.join(wanted.select(doc, index), [doc, index], "left_semi")
