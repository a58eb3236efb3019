"""Text functions as native columns.

White space, word characters and digits are Unicode-aware: the classes below
spell out what Java's own ``\\s`` and ``\\w`` leave out. Written as plain ranges
they run several times faster than the engine's Unicode mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = r"\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = rf"[\t-\r{_WIDE}]"
_LINE_WS = rf"[\t\x0b-\r{_WIDE}]"
_INK = rf"[^\t-\r{_WIDE}]"
_WORD = r"[\p{L}\p{N}_]"


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip(text: str | Column) -> Column:
    """Trims Unicode white space on both ends."""
    return F.regexp_replace(_col(text), rf"^{_WS}++|{_WS}++\z", "")


def strip_end(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), rf"{_WS}++\z", "")


def _strip_lines(text: Column) -> Column:
    # (?d): only a newline ends a line.
    return F.regexp_replace(text, rf"(?md)^{_LINE_WS}++|{_LINE_WS}++$", "")


def normalize_ws(text: str | Column) -> Column:
    """Runs of blanks to one, then runs of newlines to two, then every line trimmed."""
    blanks = F.regexp_replace(F.coalesce(_col(text), F.lit("")), " {2,}", " ")
    return _strip_lines(F.regexp_replace(blanks, r"\n{2,}", "\n\n"))


# Single characters and what replaces them, then the contextual confusions.
_CHARACTERS = {"|": " ", "┃": " ", "│": " ", "║": " ", "─": "-", "━": "-", "═": "-", "‣": "•", "⁃": "•"}
_CONFUSIONS = [
    (rf"0(?<!{_WORD}0)(?=[A-Z])", "O"),
    (rf"l(?<!{_WORD}l)(?=\p{{Nd}})", "1"),
    (r"[\p{C}&&[^\n\t]]++", ""),
]


def clean_text(text: str | Column) -> Column:
    """White space, box characters, bullets, 0/O and l/1 confusions and control characters."""
    cleaned = F.translate(normalize_ws(text), "".join(_CHARACTERS), "".join(_CHARACTERS.values()))
    cleaned = F.replace(cleaned, F.lit("…"), F.lit("..."))
    for pattern, replacement in _CONFUSIONS:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return strip(F.regexp_replace(cleaned, rf"(?md){_LINE_WS}++$", ""))


def merge_blocks(blocks: str | Column, separator: str = "\n\n") -> Column:
    kept = F.filter(F.transform(_col(blocks), strip), lambda b: b != "")
    return normalize_ws(F.array_join(kept, separator))


def extract_lines(text: str | Column, min_length: int = 1) -> Column:
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n"), strip)
    return F.when(F.coalesce(_col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.filter(lines, lambda line: F.length(line) >= min_length)
    )


def truncate(text: str | Column, max_length: int, suffix: str = "...") -> Column:
    column, keep = _col(text), max_length - len(suffix)
    # A limit below the suffix length counts from the end, as slices do.
    cut = F.lit(keep) if keep >= 0 else F.greatest(F.length(column) + keep, F.lit(0))
    return F.when(F.length(column) <= max_length, column).otherwise(F.concat(F.left(column, cut), F.lit(suffix)))


def drop_repeated_lines(text: str | Column) -> Column:
    lines = F.split(F.coalesce(_col(text), F.lit("")), "\n")
    return F.array_join(F.filter(lines, lambda line, i: (i == 0) | (line != F.get(lines, i - 1))), "\n")


def fix_hyphenation(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), rf"({_WORD})-\n({_WORD})", "$1$2")


def text_stats(text: str | Column) -> Column:
    """Characters, words, non-blank lines and non-blank paragraphs as a struct."""
    column = F.coalesce(_col(text), F.lit(""))
    body = strip(column)

    def filled(separator: str) -> Column:
        return F.size(F.filter(F.split(column, separator), lambda part: part.rlike(_INK))).cast("bigint")

    return F.struct(
        F.length(column).cast("bigint").alias("char_count"),
        F.when(body == "", 0).otherwise(F.size(F.split(body, rf"{_WS}++"))).cast("bigint").alias("word_count"),
        filled("\n").alias("line_count"),
        filled("\n\n").alias("paragraph_count"),
    )


def sentences(text: str | Column) -> Column:
    """Collapses white space and splits after ``.!?`` before a capital letter."""
    flat = strip(F.regexp_replace(_col(text), rf"{_WS}++", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?]) +(?=[A-Z])"), strip), lambda s: s != "")


# Script ranges in order of precedence, and the language each stands for.
_SCRIPTS = [
    (r"\x{41}-\x{7A}\x{C0}-\x{24F}", "en"),
    (r"\x{4E00}-\x{9FFF}", "ch"),
    (r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}", "japan"),
    (r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "korean"),
    (r"\x{600}-\x{6FF}\x{750}-\x{77F}", "ar"),
    (r"\x{400}-\x{4FF}", "ru"),
]


def script_language(text: str | Column) -> Column:
    """Language of the most frequent script; under ten letters it is ``en``.

    The ranges are disjoint, so each script is counted on what the ones before
    left over.
    """
    rest = F.coalesce(_col(text), F.lit(""))
    counts = []
    for ranges, _ in _SCRIPTS:
        left = F.regexp_replace(rest, f"[{ranges}]++", "")
        counts.append(F.length(rest) - F.length(left))
        rest = left
    most = F.greatest(*counts)
    language = F.when(sum(counts[1:], counts[0]) < 10, F.lit("en"))
    for count, (_, code) in zip(counts, _SCRIPTS):
        language = language.when(count == most, F.lit(code))
    return language


def min_length_filter(text: str | Column, length: int = 100) -> Column:
    """Strictly longer than ``length`` characters."""
    return F.length(_col(text)) > length


# --- detections in page text ---------------------------------------------------

# The marker format, the coordinate range and the leftover tokens.
_DETECTION = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
_BOX_RANGE = 999.0
_TOKENS = [("<｜end▁of▁sentence｜>", ""), ("\\coloneqq", ":="), ("\\eqqcolon", "=:")]


def detections(text: str | Column, width: Column, height: Column) -> Column:
    """Labelled boxes as ``array<struct<label, boxes array<array<int>>>>`` in pixels."""
    column = _col(text)

    def pixel(value: Column, extent: Column) -> Column:
        scaled = F.rint(value / F.lit(_BOX_RANGE) * extent).cast("int")
        return F.when((width <= 0) | (height <= 0), 0).otherwise(F.greatest(F.lit(0), F.least(extent.cast("int"), scaled)))

    def scale(box: Column) -> Column:
        return F.array(pixel(box[0], width), pixel(box[1], height), pixel(box[2], width), pixel(box[3], height))

    def parse(label: Column, coordinates: Column) -> Column:
        boxes = F.coalesce(F.from_json(strip(coordinates), "array<array<double>>"), F.array().cast("array<array<double>>"))
        whole = F.filter(boxes, lambda b: (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull()))
        return F.struct(strip(label).alias("label"), F.transform(whole, scale).alias("boxes"))

    return F.zip_with(
        F.regexp_extract_all(column, F.lit(_DETECTION), 1), F.regexp_extract_all(column, F.lit(_DETECTION), 2), parse
    )


def strip_detections(text: str | Column) -> Column:
    """Page text without detection markers and leftover tokens."""
    cleaned = F.regexp_replace(_col(text), _DETECTION, "")
    for token, replacement in _TOKENS:
        cleaned = F.replace(cleaned, F.lit(token), F.lit(replacement))
    return strip(cleaned)


# --- model responses -----------------------------------------------------------

_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"


def _extract(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def _unfenced(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped.rlike(_FENCE), strip(F.regexp_extract(stripped, _FENCE, 1))).otherwise(stripped)


def _response(parsed: Column, error: Column) -> Column:
    return F.struct(error.isNull().alias("is_valid_json"), F.to_json(parsed).alias("parsed"), error.alias("error_type"))


def parse_response(text: str | Column, keys: Sequence[str]) -> Column:
    """A model's answer as ``struct<is_valid_json, parsed, error_type>``.

    Fences, quotes and backticks go, then the outermost object is parsed and its
    keys checked. Broken JSON is reported, not repaired.
    """
    column = _col(text)
    body = _unfenced(column)
    body = F.when(body.rlike(r"(?s)^'.*'$|^\".*\"$"), F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0)))).otherwise(body)
    body = strip(F.regexp_replace(body, "^`+|`+$", ""))
    parsed = F.try_parse_json(_extract(body, r"(?s)(\{.*\})"))
    present = F.coalesce(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]).cast("array<string>"), present)
    error = (
        F.when(F.coalesce(strip(column), F.lit("")) == "", "empty_response")
        .when(parsed.isNull(), "json_decode_error")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_keys: "), F.array_join(missing, ",")))
    )
    return _response(parsed, error)


def parse_array_response(text: str | Column) -> Column:
    """The same for an outermost array."""
    column = _col(text)
    parsed = F.try_parse_json(_extract(_unfenced(column), r"(?s)(\[.*\])"))
    error = (
        F.when(F.coalesce(strip(column), F.lit("")) == "", "empty_response")
        .when(parsed.isNull(), "json_decode_error")
        .when(~F.schema_of_variant(parsed).startswith("ARRAY"), "not_an_array")
    )
    return _response(parsed, error)
