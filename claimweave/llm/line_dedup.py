"""Removal of runs of lines that repeat across the corpus, found by content-defined chunks.

A rolling hash over the hashes of two lines chooses lines that are bounded on both sides, so a
passage is cut alike wherever it stands, whatever was inserted before it. A chunk that occurs
again anywhere is an anchor: beside the place of its first occurrence it is grown line by line to both
sides. Grown runs of two or more lines with words are removed after their bytes were compared.
With ``passages`` every two neighbouring lines with words take the place of a grown run, so each run
of two or more that stands earlier goes in full, wherever it begins and ends.

Column functions only. Text moves twice: once to fetch the bytes of repeated runs, once to
rebuild the documents; everything between works on hashes, positions and ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import NO_ID, WORD, pinned

# The rolling hash: h[i] + B h[i-1] modulo a prime, of 32-bit line hashes; it stays below 2^63.
BASE = 31337
PRIME = 2147483647
# So many lines of DIVISOR are chosen; the others share chunks with their unchosen neighbours.
CHOSEN = 7
DIVISOR = 8
MIN_LINES = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(lines: Column, chosen: int = CHOSEN, divisor: int = DIVISOR) -> Column:
    """The chunks of an array of lines, as structs of the first line's index and the number of lines.

    A chunk ends with a chosen line, and before one.
    """
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"))

    def marks(h: Column) -> Column:
        rolled = lambda x, i: (x + F.coalesce(F.get(h, i - 1), F.lit(0)) * F.lit(BASE)) % PRIME
        return F.transform(h, lambda x, i: (rolled(x, i) % divisor) < chosen)

    def ends(marked: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.get(marked, i) | F.coalesce(F.get(marked, i + 1), F.lit(True)))

    def cut(last: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(last, k - 1) + 1, F.lit(0))
            return F.struct(start.alias("start"), (end - start + 1).alias("n"))

        return F.transform(last, one)

    return _let(_let(_let(hashes, marks), ends), cut)


def windows(lines: Column, min_lines: int = MIN_LINES) -> Column:
    """Every ``min_lines`` lines with words that follow each other, with the lines between them, as ``chunks`` gives them.

    A window depends on its own lines alone, so a repeated run of that many lines is all made of repeated windows.
    """

    def paired(worded: Column) -> Column:
        spans = F.transform(worded, lambda i, k: F.struct(i.alias("start"), (F.get(worded, k + (min_lines - 1)) - i + 1).alias("n")))
        return F.filter(spans, lambda c: c["n"].isNotNull())

    return _let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD)), paired)


def _keys() -> list[Column]:
    """A document is known by its id and its text; rows that repeat both are one document."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("ord"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _piece(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def _narrowed(value: Column, bits: int) -> Column:
    return F.shiftright(value, 64 - bits)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(*_keys(), F.col("text"))


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The ``windows`` to remove: ``ord``, ``th``, ``start`` and ``n`` of every occurrence but the first.

    The first is the one with the smallest (id, text hash, line); ids that are null come last.
    """

    def found(lines: Column) -> Column:
        return F.transform(
            windows(lines, min_lines),
            lambda c: _let(_piece(lines, c["start"], c["n"]), lambda t: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"))),
        )

    light = _texts(docs).select("ord", "th", F.explode(_let(_lines(F.col("text")), found)).alias("c")).select("ord", "th", "c.*")
    place = F.struct("ord", "th", "start")
    first = light.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    # Written out, so both sides of the join are plain and adaptive execution can split a window that is everywhere.
    met = light.join(pinned(first, "line-first"), ["h1", "h2"]).withColumn("is_first", place == F.col("first"))
    # Only now are bytes fetched, of the windows whose hash occurs again.
    asked = met.groupBy("ord", "th").agg(F.collect_set(F.struct("h1", "h2", "start", "n", "is_first")).alias("asked"))
    fetched = _pieces(docs, asked).select("ord", "th", "a.*", "piece")
    heads = fetched.where("is_first").select("h1", "h2", F.col("piece").alias("head"))
    return fetched.where("not is_first").join(heads, ["h1", "h2"]).where(F.col("piece") == F.col("head")).select("ord", "th", "start", "n")


def _pieces(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``ord, th, a, piece`` for every entry of ``asked`` (an array of structs with ``start`` and ``n``)."""
    texts = _texts(docs).dropDuplicates(["ord", "th"])
    return (
        texts.join(asked, ["ord", "th"])
        .select("ord", "th", F.explode(_let(_lines(F.col("text")), lambda lines: F.transform(F.col("asked"), lambda a: F.struct(a.alias("a"), _piece(lines, a["start"], a["n"]).alias("piece"))))).alias("c"))
        .select("ord", "th", "c.*")
    )


def grown_runs(docs: DataFrame, chosen: int = CHOSEN, divisor: int = DIVISOR, min_lines: int = MIN_LINES, hash_bits: int = 64) -> DataFrame:
    """The runs to remove: ``ord``, ``th``, ``start`` and ``n``.

    A chunk's occurrences but the first, the one with the smallest (id, text hash, line), are
    anchors. All anchors between one document and one earlier place, at one distance, lie on a diagonal; the
    stretches of equal lines along it that hold an anchor are the grown runs. They count with ``min_lines`` lines
    with words, from the first such line to the last. ``hash_bits`` narrows all hashes, for
    tests: runs whose hashes meet but whose bytes differ are never removed.
    """

    def described(lines: Column) -> Column:
        worded = F.transform(lines, lambda x: x.rlike(WORD))
        hashes = F.transform(lines, lambda x: _narrowed(F.xxhash64(x), hash_bits))

        def anchor(c: Column, w: Column) -> Column:
            text = _piece(lines, c["start"], c["n"])
            hash_ = lambda seed: _narrowed(F.xxhash64(F.lit(seed), text), hash_bits)
            return F.struct(c["start"].alias("start"), hash_(2).alias("h1"), hash_(3).alias("h2"))

        anchors = lambda w: F.transform(F.filter(chunks(lines, chosen, divisor), lambda c: F.exists(F.slice(w, c["start"] + 1, c["n"]), lambda x: x)), lambda c: anchor(c, w))
        return _let(worded, lambda w: F.struct(w.alias("worded"), hashes.alias("hashes"), anchors(w).alias("anchors")))

    # Written once: sixteen bytes or so a line, that all steps up to the fetching of bytes read.
    light = pinned(_texts(docs).select("ord", "th", _let(_lines(F.col("text")), described).alias("d")).select("ord", "th", "d.*").dropDuplicates(["ord", "th"]), "line-light")
    anchors = light.select("ord", "th", F.explode("anchors").alias("c")).select("ord", "th", "c.*")
    place = F.struct("ord", "th", "start")
    first = anchors.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    # Written out, so both sides of the join are plain and adaptive execution can split a chunk that is everywhere.
    met = anchors.join(pinned(first, "line-first"), ["h1", "h2"]).where(place != F.col("first"))
    diagonals = met.groupBy("ord", "th", F.col("first.ord").alias("ord0"), F.col("first.th").alias("th0"), (F.col("start") - F.col("first.start")).alias("delta")).agg(F.collect_set("start").alias("starts"))
    mine = pinned(diagonals.join(light.select("ord", "th", "worded", "hashes"), ["ord", "th"]), "line-diagonals")
    theirs = light.select(F.col("ord").alias("ord0"), F.col("th").alias("th0"), F.col("hashes").alias("hashes0"))
    lined = mine.join(theirs, ["ord0", "th0"])

    delta = F.col("delta")
    low, high = F.greatest(F.lit(0), delta), F.least(F.size("hashes"), F.size("hashes0") + delta)
    # Where the two texts differ along the diagonal, and behind its end; the stretches lie between.
    breaks = F.filter(F.sequence(low, high), lambda i: (i == high) | (F.get("hashes", i) != F.get("hashes0", i - delta)))

    def stretches(at: Column) -> Column:
        spans = F.transform(at, lambda end, k: F.struct(F.coalesce(F.get(at, k - 1) + 1, low).alias("a"), end.alias("b")))
        held = F.filter(spans, lambda s: (s["a"] < s["b"]) & F.exists("starts", lambda x: (x >= s["a"]) & (x < s["b"])))
        return F.transform(held, lambda s: F.filter(F.sequence(s["a"], s["b"] - 1), lambda i: F.get("worded", i)))

    runs = lined.select("ord", "th", "ord0", "th0", "delta", F.explode(_let(breaks, stretches)).alias("w")).where(F.size("w") >= min_lines)
    start = F.col("w")[0]
    runs = runs.select("ord", "th", "ord0", "th0", start.alias("start"), (F.element_at("w", -1) - start + 1).alias("n"), (start - delta).alias("start0"))

    # Only now are bytes fetched: of the runs, and once of each place that they repeat.
    own = runs.select("ord", "th", F.struct(F.lit(False).alias("head"), "start", "n", "ord0", "th0", "start0").alias("a"))
    heads = runs.select(F.col("ord0").alias("ord"), F.col("th0").alias("th"), F.struct(F.lit(True).alias("head"), F.col("start0").alias("start"), "n", "ord0", "th0", "start0").alias("a"))
    asked = own.unionByName(heads).groupBy("ord", "th").agg(F.collect_set("a").alias("asked"))
    fetched = _pieces(docs, asked).select("ord", "th", "a.*", "piece")
    spot = ["ord0", "th0", "start0", "n"]
    found = fetched.where("not head").join(fetched.where("head").select(*spot, F.col("piece").alias("earlier")), spot)
    return found.where(F.col("piece") == F.col("earlier")).select("ord", "th", "start", "n")


def dedup_lines(docs: DataFrame, passages: bool = False, **options) -> DataFrame:
    """Every document with what is left of it.

    Columns: ``row`` (the document as it came, so its columns cannot clash), ``kept_text``,
    ``n_lines`` and ``n_removed`` (lines). A null text stays null and has no lines; an empty
    text has one line; texts of any length are taken whole. Rows that repeat id and text are one document and
    all fare alike. An empty table gives no rows. With ``passages=True`` a line goes if it lies in
    ``min_lines`` lines with words (and any blank ones between them) that also start earlier: in a
    document before this one, or above in the same one.
    """
    found = repeated_windows(docs, **options) if passages else grown_runs(docs, **options)
    covered = F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    gone = found.groupBy("ord", "th").agg(F.array_distinct(F.flatten(covered)).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), *_keys()).join(gone, ["ord", "th"], "left")
    text = F.col("row.text")

    def rebuilt(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return rows.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(_let(_lines(text), rebuilt)).alias("kept_text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
