"""Text functions and document jobs over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import lookups
from claimweave.functions import text as fn
from claimweave.operators import documents as ops
from claimweave.plans.registry import Registry
from claimweave.plans.tables import table
from claimweave.session import spread

REGISTRY = Registry.empty()

# White space as the Spark functions see it, for the other engine's regular expressions.
_CHARS = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINE = _CHARS.replace(r"\n", "")


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^[{_CHARS}]+|[{_CHARS}]+$', '', 'g')"


def _normalized(sql: str) -> str:
    collapsed = f"regexp_replace(regexp_replace({sql}, '  +', ' ', 'g'), '\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({collapsed}, '(?m)^[{_LINE}]+|[{_LINE}]+$', '', 'g')"


def _cleaned(sql: str) -> str:
    steps = [
        ("[|┃│║]", "' '"), ("[─━═]", "'-'"), ("[•‣⁃]", "'•'"), ("…", "'...'"),
        (r"(^|[^\pL\pN_])0([A-Z])", r"'\1O\2'"), (r"(^|[^\pL\pN_])l(\p{Nd})", r"'\11\2'"),
    ]
    out = _normalized(sql)
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '{pattern}', {replacement}, 'g')"
    # Control characters other than tab and newline.
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}\\p{{Cf}}\\p{{Co}}]', '', 'g')"
    return _strip(f"regexp_replace({out}, '(?m)[{_LINE}]+$', '', 'g')")


def _document(name: str, make, sql: str | None):
    @REGISTRY.add(name, f"SELECT doc_id, {sql} AS result FROM documents" if sql else None)
    def query(spark, sf_dir):
        return spread(table(spark, sf_dir, "documents")).select("doc_id", make("text").alias("result"))


_LINES = "string_split(text, chr(10))"
_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(" + _strip(f"regexp_replace(text, '[{_CHARS}]+', ' ', 'g')")
    + r", '([.!?]) +([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"
)
_document("d01_normalize_ws", fn.normalize_ws, _normalized("text"))
_document("d02_clean_text", fn.clean_text, _cleaned("text"))
_document(
    "d03_merge_blocks",
    lambda c: fn.merge_blocks(F.split(c, "\n")),
    _normalized(f"array_to_string(list_filter(list_transform({_LINES}, lambda b: {_strip('b')}), lambda b: b <> ''), chr(10) || chr(10))"),
)
_document(
    "d04_extract_lines",
    lambda c: F.array_join(fn.extract_lines(c, 20), "|"),
    f"array_to_string(list_filter(list_transform({_LINES}, lambda b: {_strip('b')}), lambda b: length(b) >= 20), '|')",
)
_document("d05_truncate", lambda c: fn.truncate(c, 200), "CASE WHEN length(text) <= 200 THEN text ELSE left(text, 197) || '...' END")
_document(
    "d06_drop_repeated_lines",
    fn.drop_repeated_lines,
    f"array_to_string(list_filter({_LINES}, lambda b, i: i = 1 OR b <> {_LINES}[i - 1]), chr(10))",
)
_document(
    "d07_fix_hyphenation",
    lambda c: fn.fix_hyphenation(F.regexp_replace(c, "([a-z]) (on|in) ", "$1-\n$2 ")),
    "regexp_replace(regexp_replace(text, '([a-z]) (on|in) ', '\\1-' || chr(10) || '\\2 ', 'g'), '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g')",
)


def _filled(sql: str) -> str:
    return f"CAST(len(list_filter({sql}, lambda p: regexp_matches(p, '[^{_CHARS}]'))) AS BIGINT)"


@REGISTRY.add(
    "d08_text_stats",
    f"SELECT doc_id, length(text) AS char_count, {_filled(f'string_split_regex(text, {chr(39)}[{_CHARS}]+{chr(39)})')} AS word_count, "
    f"{_filled(_LINES)} AS line_count, {_filled('string_split(text, chr(10) || chr(10))')} AS paragraph_count FROM documents",
)
def text_stats(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", fn.text_stats("text").alias("s")).select("doc_id", "s.*")


_document("d09_sentences", lambda c: F.array_join(fn.sentences(c), "|"), f"array_to_string({_SENTENCES}, '|')")


_CHUNKS = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, sents, list_transform(sents, lambda x: length(x)) AS lens FROM (SELECT doc_id, {_SENTENCES} AS sents FROM documents) WHERE len(sents) > 0
), walk AS (
    SELECT doc_id, 0 AS i, 0 AS b, 0 AS f, 0 AS head, 0 AS used, -1 AS cut_b, -1 AS cut_e FROM docs
    UNION ALL
    SELECT doc_id, i + 1, CASE WHEN NOT shut THEN b WHEN whole THEN b ELSE i - n END, CASE WHEN shut THEN i ELSE f END, CASE WHEN shut THEN fresh_head ELSE head END,
           CASE WHEN shut THEN fresh_head ELSE used END + l, CASE WHEN shut THEN b ELSE -1 END, CASE WHEN shut THEN i ELSE -1 END
    FROM (
        SELECT *, CASE WHEN whole THEN head + tail + n ELSE tail + greatest(n - 1, 0) END AS fresh_head FROM (
            SELECT *, n = i - f AND f > b AND tail + head <= 200 AS whole FROM (
                SELECT *, CAST(coalesce(list_sum(lens[i - n + 1 : i]), 0) AS INTEGER) AS tail FROM (
                    SELECT w.*, lens, CAST(lens[i + 1] AS INTEGER) AS l, b < i AND used + lens[i + 1] > 1000 AS shut,
                           CAST(len(list_filter(range(f, i), lambda j: list_sum(lens[j + 1 : i]) <= 200)) AS INTEGER) AS n
                    FROM walk w JOIN docs d ON d.doc_id = w.doc_id WHERE i < len(lens)
                )
            )
        )
    )
), cuts AS (
    SELECT doc_id, cut_b AS b, cut_e AS e FROM walk WHERE cut_b >= 0
    UNION ALL SELECT w.doc_id, b, i FROM walk w JOIN docs d ON d.doc_id = w.doc_id WHERE i = len(lens)
), texts AS (
    SELECT cuts.doc_id, b, e, array_to_string(sents[b + 1 : e], ' ') AS text FROM cuts JOIN docs ON docs.doc_id = cuts.doc_id
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk_index, text, length(text) AS char_count FROM texts WHERE length(text) >= 100
"""


@REGISTRY.add("d10_chunk", _CHUNKS)
def chunk(spark, sf_dir):
    return ops.chunk(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text")


def _letters(ranges: str) -> str:
    return f"length(regexp_replace(text, '[^{ranges}]', '', 'g'))"


# Fixed values, written out again for the other engine: script ranges in order of precedence and their languages.
_RANGES = [
    (r"A-z\x{00C0}-\x{024F}", "en"),
    (r"\x{4E00}-\x{9FFF}", "ch"),
    (r"\x{3040}-\x{30FF}", "japan"),
    (r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "korean"),
    (r"\x{0600}-\x{06FF}\x{0750}-\x{077F}", "ar"),
    (r"\x{0400}-\x{04FF}", "ru"),
]
_SCRIPT_COUNTS = ", ".join(f"{_letters(ranges)} AS c{i}" for i, (ranges, _) in enumerate(_RANGES))
_document(
    "d11_script_language",
    fn.script_language,
    None,
)
REGISTRY.oracles["d11_script_language"] = (
    "SELECT doc_id, CASE WHEN c0 + c1 + c2 + c3 + c4 + c5 < 10 THEN 'en' "
    + " ".join(f"WHEN c{i} = greatest(c0, c1, c2, c3, c4, c5) THEN '{code}'" for i, (_, code) in enumerate(_RANGES))
    + f" END AS result FROM (SELECT doc_id, {_SCRIPT_COUNTS} FROM documents)"
)


# So few pieces to a part that most documents have several.
_PARTS = 2


@REGISTRY.add(
    "d10_join_sections",
    "WITH filled AS (SELECT conv_id, turn, turn // 2 AS part, text FROM conversations WHERE turn % 4 <> 2), "
    "parts AS (SELECT conv_id, part, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM filled GROUP BY conv_id, part) "
    "SELECT conv_id, part, CASE WHEN part = min(part) OVER (PARTITION BY conv_id) THEN '' ELSE chr(10) || chr(10) END || body AS text FROM parts",
)
def join_sections(spark, sf_dir):
    """Turns as sections; every fourth one is blank."""
    sections = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 2, F.col("text")).otherwise(F.lit(" \n")).alias("text"))
    return ops.join_sections(sections, "conv_id", "turn", "text", per_part=_PARTS)


_PIECE = "chr(10) || '---' || chr(10) || chr(10) || chr(10) || '## Page ' || (turn + 1) || chr(10) || chr(10) || " + _strip("text || ' ![](conv/page-' || lpad(CAST(turn AS VARCHAR), 3, '0') || '/images/0.jpg)'") + " || chr(10)"


@REGISTRY.add(
    "d12_assemble_pages",
    f"WITH parts AS (SELECT conv_id, turn // {_PARTS} AS part, string_agg({_PIECE}, '' ORDER BY turn) AS body FROM conversations GROUP BY 1, 2), "
    "ends AS (SELECT *, min(part) OVER (PARTITION BY conv_id) AS low, max(part) OVER (PARTITION BY conv_id) AS high FROM parts), "
    "titled AS (SELECT *, CASE WHEN part = low THEN '# ' || conv_id ELSE '' END || body AS whole FROM ends) "
    f"SELECT conv_id, part, CASE WHEN part = high THEN regexp_replace(whole, '[{_CHARS}]+$', '') || chr(10) ELSE whole END AS text FROM titled",
)
def assemble_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" ![](./images/0.jpg)")).alias("markdown"))
    return ops.assemble_pages(pages, "conv_id", "turn", prefix="conv/", per_part=_PARTS).select("conv_id", "part", "text")


@REGISTRY.add(
    "d13_page_array",
    f"SELECT conv_id, turn // {_PARTS} AS part, string_agg(CASE WHEN role = 'assistant' THEN '' ELSE text END, '|' ORDER BY turn) AS pages FROM conversations GROUP BY 1, 2",
)
def page_array(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("text")).alias("text"))
    return ops.page_array(pages, "conv_id", "turn", per_part=_PARTS).select("conv_id", "part", F.array_join("pages", "|").alias("pages"))


@REGISTRY.add(
    "d14_strip_detections",
    "SELECT conv_id, turn, " + _strip("text") + " AS cleaned, role || ':' || CAST(least(800, round_even(least(turn * 100, 900) / 999.0 * 800, 0)) AS INT) || ',' || "
    "CAST(round_even(20 / 999.0 * 600, 0) AS INT) || ',' || CAST(round_even(500 / 999.0 * 800, 0) AS INT) || ',600' AS boxes FROM conversations",
)
def strip_detections(spark, sf_dir):
    box = F.format_string("[[%d, 20, 500, 1200], [1, 2]]", F.least(F.col("turn") * 100, F.lit(900)))
    marked = table(spark, sf_dir, "conversations").withColumn("marked", F.concat(F.lit("<|ref|>"), "role", F.lit("<|/ref|><|det|>"), box, F.lit("<|/det|>"), "text"))
    found = fn.detections("marked", F.lit(800), F.lit(600))
    flat = F.array_join(F.transform(found, lambda d: F.concat(d["label"], F.lit(":"), F.array_join(F.flatten(d["boxes"]).cast("array<string>"), ","))), ";")
    return marked.select("conv_id", "turn", fn.strip_detections("marked").alias("cleaned"), flat.alias("boxes"))


@REGISTRY.add(
    "d15_page_confidence",
    f"WITH lines AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS i FROM documents) "
    "SELECT doc_id AS doc, CAST(0 AS BIGINT) AS page, i // 5 AS part, string_agg(line, chr(10) ORDER BY i) AS text, "
    "round(sum(sum((length(line) % 100) / 100.0)) OVER w / sum(count(*)) OVER w, 6) AS average_confidence FROM lines GROUP BY doc_id, i // 5 WINDOW w AS (PARTITION BY doc_id)",
)
def page_confidence(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    scored = lines.withColumn("confidence", (F.length("text") % 100) / F.lit(100.0))
    return ops.page_confidence(scored, per_part=5)


@REGISTRY.add("d16_size_filter", "SELECT page_id, url FROM pages WHERE strlen(html) <= CAST(floor(0.002 * 1048576) AS BIGINT)")
def size_filter(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").alias("length"))
    return ops.size_filter(files, 0.002).drop("length")


def _pick(values: list[str], key: str, quote: bool = True) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if quote else v) for i, v in enumerate(values)) + " END"


# Every extension, some in capitals, with double ones, without any and unknown ones.
_ENDINGS = {
    "text": [".txt", ".log", ".md", ".rst", ".nfo", ".css"],
    "markup": [".html", ".xml", ".json", ".jsonl", ".yaml", ".yml", ".ini", ".cfg", ".toml", ".conf", ".properties", ".x.Json"],
    "documentation": [".tex", ".ltx", ".srt", ".vtt", ".po", ".pot", ".org", ".wiki", ".bbcode", ".texinfo"],
    "image": [".jpg", ".JPEG", ".png", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".pbm", ".pgm", ".ppm", ".gif", ".raw", ".cr2", ".nef", ".arw", ".dng"],
    "vector": [".svg"],
    "word": [".docx", ".dotx", ".doc", ".odt", ".rtf", ".pages"],
    "pdf": [".pdf", ".PDF"],
    "ebook": [".epub", ".mobi", ".azw", ".azw3"],
    "spreadsheet": [".xls", ".xlsx", ".xlsm", ".ods", ".csv", ".tsv", ".numbers"],
    "archive": [".zip", ".tar", ".gz", ".bz2", ".7z", ".xz", ".rar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz"],
    "code": [".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".go", ".rs", ".sh", ".ps1", ".sql", ".php", ".rb", ".swift", ".ipynb"],
    "email": [".msg", ".eml", ".ics", ".vcf", ".vcard"],
    "web_archive": [".mhtml", ".mht", ".har"],
    "unknown": ["", ".", ".nothing", ".tar.nothing"],
}
_ENDING_LIST = [ending for endings in _ENDINGS.values() for ending in endings]
_ENDING_KIND = [kind for kind, endings in _ENDINGS.items() for _ in endings]


@REGISTRY.add("d17_file_category", f"SELECT p_partkey, {_pick(_ENDING_KIND, 'p_partkey')} AS category FROM part")
def file_category(spark, sf_dir):
    name = F.concat(F.lit("/data/a.b/"), F.replace("p_name", F.lit("."), F.lit("")), F.expr(_pick(_ENDING_LIST, "p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", lookups.file_category(name).alias("category"))


@REGISTRY.add(
    "d18_sample_positions",
    "SELECT conv_id, turn, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE turn % 3 <> 1) "
    "WHERE n < 3 OR i IN (0, n // 2, n - 1)",
)
def sample_positions(spark, sf_dir):
    """Without every third turn, so the index has gaps."""
    turns = table(spark, sf_dir, "conversations").where("turn % 3 <> 1")
    return ops.sample_positions(turns, "conv_id", "turn").select("conv_id", "turn", "text")


# Every name and code, in changing case and spacing, and some that stand for nothing.
_NAMED = {
    "AL": ["albania"], "AU": ["Australia"], "BE": ["Belgium "], "BG": ["bulgaria"], "CH": ["SWITZERLAND"], "CN": ["China", "People's Republic of China"], "CY": ["Cyprus", "republic of cyprus"],
    "DE": ["Germany"], "DK": ["denmark"], "EG": ["Egypt"], "ES": ["spain"], "FR": [" France"], "GB": ["United Kingdom", "uk", "Great Britain", "BRITAIN"], "GR": ["greece"], "HK": ["Hong Kong", "HongKong"],
    "ID": ["indonesia"], "IL": ["Israel"], "IN": ["india"], "IT": ["Italy"], "JP": ["Japan"], "KR": ["South Korea", "korea", "Republic of Korea"], "LA": ["Laos", "lao"], "MO": ["Macau", "macao"],
    "MY": ["Malaysia"], "PH": ["philippines", "Philippine"], "RO": ["Romania"], "RU": ["Russian Federation", "russia"], "SA": ["Saudi Arabia", "saudi"], "SE": ["Sweden"], "SG": ["singapore"],
    "TH": ["Thailand"], "TR": ["turkey"], "TW": ["Taiwan"], "VT": ["Vietnam", "viet nam"],
}
_INPUTS = [name for names in _NAMED.values() for name in names] + [f" {code.lower()} " for code in _NAMED] + ["Unknown", "", "hong  kong", "XX"]
_CODES = [f"'{code}'" for code, names in _NAMED.items() for _ in names] + [f"'{code}'" for code in _NAMED] + ["NULL"] * 4


@REGISTRY.add(
    "d19_normalize_country",
    f"SELECT c_custkey, code, code IS NOT NULL AS supported FROM (SELECT c_custkey, {_pick(_CODES, 'c_custkey', quote=False)} AS code FROM customer)",
)
def normalize_country(spark, sf_dir):
    name = F.expr(_pick([name.replace("'", r"\'") for name in _INPUTS], "c_custkey"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", lookups.normalize_country(name).alias("code"), lookups.is_supported_country(name).alias("supported")
    )


_OBJECT = "concat('{{\"role\": \"', role, '\", \"turn\": ', cast(turn as {text}), '}}')"
_FORMS = [
    "concat('```json\\n', {o}, '\\n```')", "concat('\"', {o}, '\"')", "concat('Sure, here: ', {o}, ' - done.')",
    "'{{\"role\": \"x\"}}'", "'  '", "concat('{{\"role\": ', text)", "concat('```', {o}, '```')",
]
_RESULTS = ["NULL", "NULL", "NULL", "'missing_keys: turn'", "'empty_response'", "'json_decode_error'", "NULL"]


def _response(spark, sf_dir):
    form = _pick([f.format(o=_OBJECT.format(text="string")).replace("{{", "{").replace("}}", "}") for f in _FORMS], "(conv_id + turn)", quote=False)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(form).alias("response"))


@REGISTRY.add(
    "d20_parse_response",
    f"SELECT conv_id, turn, error_type IS NULL AS is_valid_json, error_type, CASE WHEN error_type IS NULL THEN role WHEN error_type LIKE 'missing%' THEN 'x' END AS role FROM "
    f"(SELECT conv_id, turn, role, {_pick(_RESULTS, '(conv_id + turn)', quote=False)} AS error_type FROM conversations)",
)
def parse_response(spark, sf_dir):
    parsed = _response(spark, sf_dir).withColumn("p", fn.parse_response("response", ["role", "turn"]))
    return parsed.select("conv_id", "turn", "p.is_valid_json", "p.error_type", F.get_json_object("p.parsed", "$.role").alias("role"))


_ARRAYS = ["concat('Answer: [', cast(turn as string), ', 2] ok')", "'```json\\n[]\\n```'", "'{\"a\": 1}'", "''", "'[1, 2'"]
_ARRAY_RESULTS = ["NULL", "NULL", "'not_an_array'", "'empty_response'", "'json_decode_error'"]


@REGISTRY.add(
    "d21_parse_array_response",
    f"SELECT conv_id, turn, error_type IS NULL AS is_valid_json, error_type FROM (SELECT conv_id, turn, {_pick(_ARRAY_RESULTS, '(conv_id + turn)', quote=False)} AS error_type FROM conversations)",
)
def parse_array_response(spark, sf_dir):
    response = F.expr(_pick(_ARRAYS, "(conv_id + turn)", quote=False))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.parse_array_response(response).alias("p"))
    return parsed.select("conv_id", "turn", "p.is_valid_json", "p.error_type")


@REGISTRY.add("d22_min_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 100")
def min_length(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).filter(fn.min_length_filter("text")).select("doc_id", "n_chars")
