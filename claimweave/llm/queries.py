"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import byte_network, exact_dedup, importance, jaccard_join, language_id, line_dedup, mixing, packing, periodic_runs, quality, revisits, sharding, suffix_dedup
from claimweave.llm.common import WORD, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _crc32_sql(text: str) -> str:
    """The checksum of a string's UTF-8 bytes, a byte at a time; the table follows from the polynomial 3988292384, a fixed value."""
    table_ = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (3988292384 if value & 1 else 0)
        table_.append(value)
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, {table_}[1 + (xor(c, b) & 255)])), 4294967295)"


_OP1_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n_lines
    FROM documents WHERE text IS NOT NULL
), hashed AS (
    SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM lines
), marked AS (
    SELECT *, (h + 31337 * coalesce(lag(h) OVER w, 0)) % 2147483647 % 8 < 7 AS chosen FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
    SELECT *, CASE WHEN chosen OR coalesce(lead(chosen) OVER w, true) THEN 1 ELSE 0 END AS ends FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended
), chunked AS (
    SELECT doc_id, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk HAVING bool_or(worded)
), ranked AS (
    SELECT doc_id, start, row_number() OVER w AS k, first_value(doc_id) OVER w AS doc0, first_value(start) OVER w AS start0 FROM chunked WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)
), anchors AS (
    SELECT DISTINCT doc_id, doc0, start - start0 AS delta, start FROM ranked WHERE k > 1
), equal AS (
    SELECT d.doc_id, d.doc0, d.delta, x.i, x.worded, x.i - row_number() OVER (PARTITION BY d.doc_id, d.doc0, d.delta ORDER BY x.i) AS run
    FROM (SELECT DISTINCT doc_id, doc0, delta FROM anchors) d JOIN hashed x ON x.doc_id = d.doc_id JOIN hashed y ON y.doc_id = d.doc0 AND y.i = x.i - d.delta AND y.line = x.line
), held AS (
    SELECT DISTINCT e.doc_id, e.doc0, e.delta, e.run FROM equal e JOIN anchors a ON a.doc_id = e.doc_id AND a.doc0 = e.doc0 AND a.delta = e.delta AND a.start = e.i
), spans AS (
    SELECT e.doc_id, min(CASE WHEN worded THEN i END) AS a, max(CASE WHEN worded THEN i END) AS b
    FROM equal e JOIN held h ON h.doc_id = e.doc_id AND h.doc0 = e.doc0 AND h.delta = e.delta AND h.run = e.run GROUP BY e.doc_id, e.doc0, e.delta, e.run HAVING count(CASE WHEN worded THEN 1 END) >= 2
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM spans
), rebuilt AS (
    SELECT l.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN rebuilt ON d.doc_id = rebuilt.doc_id
"""


@query("op1_line_dedup", _OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256).alias("kept_sha256"))


_OP1_PASSAGES_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents WHERE text IS NOT NULL
), worded AS (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
    SELECT w.doc_id, w.i AS start, w.next AS last, array_to_string(string_split(d.text, chr(10))[w.i + 1 : w.next + 1], chr(10)) AS body
    FROM worded w JOIN documents d ON d.doc_id = w.doc_id WHERE w.next IS NOT NULL
), ranked AS (
    SELECT doc_id, start, last, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AS removed FROM windows
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, last + 1)) AS i FROM ranked WHERE removed
), rebuilt AS (
    SELECT l.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN rebuilt ON d.doc_id = rebuilt.doc_id
"""


@query("op1_line_passages", _OP1_PASSAGES_SQL)
def op1_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), passages=True)
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256).alias("kept_sha256"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn_from(docs), ["doc_id"])
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def capture_log(pages: DataFrame) -> DataFrame:
    """Captures of the given pages as WARC-like records. Four pages with neighbouring ids are one address, each in
    the spelling (scheme, tracking, fragment) of its own URL, so a later revisit often meets another page's
    response; every eleventh page has none. A page is fetched in full at ten times its id and asked for again later,
    some of the first before any response. Every other four share an etag; the answer, a 304, carries it, a weak
    or a wrong one, only the modification time, or no validator. Some responses have no id, and some the id of another."""
    page = F.col("page_id")
    four = F.expr("page_id div 4")
    spelled = F.concat(
        F.regexp_extract("url", "^[A-Za-z]+://", 0), F.when(page % 2 == 0, "www.").otherwise(""), F.lit("site"), four.cast("string"), F.lit(".example.org/p"), F.regexp_extract("url", r"(\?utm_source=[a-z]+)?(#.*)?$", 0)
    )
    grouped = pages.withColumn("url", F.when(page % 11 != 3, spelled))
    etag = F.concat(F.lit('"'), F.md5(F.when(four % 2 == 0, four.cast("string")).otherwise(F.coalesce(F.col("html"), F.lit("")))), F.lit('"'))
    modified = F.concat(F.lit("day "), (four % 365).cast("string"))
    day = lambda at: F.concat(F.lit("at "), at.cast("string"))
    first_id = F.when(page % 17 == 0, F.lit(None)).when(page % 19 == 1, F.concat(F.lit("r"), (page - 1).cast("string"))).otherwise(F.concat(F.lit("r"), page.cast("string")))
    first = grouped.select(
        first_id.alias("record_id"), "url", (page * 10).alias("at"), F.lit(revisits.RESPONSE).alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day(page * 10), F.lit("etag"), etag, F.lit("last-modified"), modified).alias("headers"), F.col("html").alias("body"),
    )
    later = F.when((page % 4 == 0) & (page % 13 == 5), page * 10 - 3).otherwise(page * 10 + 5 + (page % 7) * 4)
    told = F.when(page % 5 == 0, F.concat(F.lit("W/"), etag)).when(page % 5 == 1, F.lit('"other"')).when(page % 5 == 2, F.lit(None)).when(page % 5 == 3, F.lit(None)).otherwise(etag)
    answers = F.map_filter(
        F.create_map(
            F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), day(later), F.lit("etag"), told,
            F.lit("last-modified"), F.when(page % 5 == 2, modified), F.lit("set-cookie"), F.lit("a=1"),
        ),
        lambda _, value: value.isNotNull(),
    )
    again = grouped.select(
        F.concat(F.lit("v"), page.cast("string")).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"), later.alias("at"), F.lit(revisits.REVISIT).alias("kind"), F.lit(304).alias("status"),
        answers.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)


_OP3_SQL = r"""
WITH grouped AS (
    SELECT page_id, html, page_id // 4 AS four, CASE WHEN page_id % 11 <> 3 THEN regexp_extract(url, '^[A-Za-z]+://', 0) || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || (page_id // 4)
           || '.example.org/p' || regexp_extract(url, '(\?utm_source=[a-z]+)?(#.*)?$', 0) END AS url FROM pages
), bare AS (
    SELECT page_id, html, four, md5(CASE WHEN four % 2 = 0 THEN CAST(four AS VARCHAR) ELSE coalesce(html, '') END) AS tag, regexp_replace(trim(url), '#.*$', '') AS url FROM grouped
), parts AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '([?&])utm_[a-z]+=[^&]*(&|$)', '\1', 'g'), '[?&]+$', ''), '/$', '') AS path FROM bare
), named AS (
    SELECT *, CASE WHEN host <> '' THEN host || path END AS canonical_url,
           CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 19 = 1 THEN 'r' || (page_id - 1) ELSE 'r' || page_id END AS first_id,
           CASE WHEN page_id % 4 = 0 AND page_id % 13 = 5 THEN page_id * 10 - 3 ELSE page_id * 10 + 5 + (page_id % 7) * 4 END AS later FROM parts
), met AS (
    SELECT v.page_id, v.canonical_url, v.later, v.tag AS own_tag, v.four AS own_four, r.page_id AS source, r.first_id, r.tag, r.html, r.four,
           row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC) AS k
    FROM named v LEFT JOIN named r ON r.canonical_url = v.canonical_url AND r.page_id * 10 < v.later AND r.html IS NOT NULL
), judged AS (
    SELECT *, CASE WHEN canonical_url IS NULL THEN 'no_url' WHEN source IS NULL THEN 'no_response'
                   WHEN page_id % 5 IN (0, 4) THEN CASE WHEN own_tag = tag THEN 'resolved' ELSE 'changed' END
                   WHEN page_id % 5 = 1 THEN 'changed'
                   WHEN page_id % 5 = 2 THEN CASE WHEN own_four % 365 = four % 365 THEN 'resolved' ELSE 'changed' END ELSE 'no_validator' END AS outcome
    FROM met WHERE k = 1
)
SELECT 'v' || page_id AS record_id, canonical_url, later AS at, outcome, first_id AS source_id,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=at ' || later || ';etag=' || CASE WHEN page_id % 5 = 0 THEN 'W/' ELSE '' END || '"' || tag || '";last-modified=day ' || (four % 365) END AS headers,
       CASE WHEN outcome = 'resolved' THEN sha256(html) END AS body_sha256
FROM judged
"""


@query("op3_revisits", _OP3_SQL)
def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(capture_log(table(spark, sf_dir, "pages")))
    header = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "canonical_url", "at", "outcome", "source_id", F.array_join(header, ";").alias("headers"), F.sha2("body", 256).alias("body_sha256"))


_OP4_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs
), windows AS (
    SELECT doc_id, i, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c, lead(word, 3) OVER w AS d, lead(word, 4) OVER w AS e
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), again AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS times FROM windows WHERE e IS NOT NULL) WHERE times > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS t(k) GROUP BY doc_id
), tops AS (
    SELECT doc_id, max(times) AS top FROM (SELECT doc_id, word, count(*) AS times FROM words GROUP BY doc_id, word) GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), line_counts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
    SELECT docs.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(top, 0) AS top,
           length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
    FROM docs LEFT JOIN repeats ON docs.doc_id = repeats.doc_id LEFT JOIN tops ON docs.doc_id = tops.doc_id LEFT JOIN line_counts ON docs.doc_id = line_counts.doc_id
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 10 * n_dup_lines > 4 * n_lines AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND NOT 2 * letters < word_chars AND NOT 10 * top > 3 * n_words AS kept
FROM judged
"""


@query("op4_quality_rules", _OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", *quality.MEASURES, "base_failed", "kept")


_OP5_SQL = """
WITH bytes AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), places AS (
    SELECT doc_id, unnest(range(n - 99)) AS p FROM bytes
), windows AS (
    SELECT places.doc_id, p, sha256(substr(h, 2 * p + 1, 200)) AS window_ FROM places JOIN bytes ON places.doc_id = bytes.doc_id
), earlier AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY window_ ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), numbered AS (
    SELECT doc_id, p, sum(far) OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS far FROM earlier)
), spans AS (
    SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run
), edges AS (
    SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), cut AS (
    SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM edges JOIN bytes d ON edges.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""


@query("op5_suffix_dedup", _OP5_SQL)
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_OP7_SQL = f"""
WITH light AS (
    SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE {_crc32_sql("text")} END AS text_crc32, md5('20240817:' || doc_id) AS draw FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) AS k, count(*) OVER (PARTITION BY source) AS rows FROM light
), cut AS (
    SELECT *, row_number() OVER (ORDER BY CAST(2 * k - 1 AS DOUBLE) / CAST(2 * rows AS DOUBLE), source NULLS FIRST, draw, doc_id, text_crc32, size) - 1 AS n, count(*) OVER () AS total FROM ranked
), placed AS (
    SELECT *, CAST(n * 24 // total AS INTEGER) AS shard FROM cut
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, n - (shard * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed
"""


@query("op7_sharding", _OP7_SQL)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


_OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums
), filled AS (
    SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS full_size, coalesce(sum(weight) OVER w, 0) AS full_weight
    FROM weighed WINDOW w AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source_size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), totals AS (
    SELECT CAST(sum(source_size) AS DOUBLE) AS size, sum(weight) AS weight FROM weighed
), level AS (
    SELECT max((CAST(1.5 AS DOUBLE) * totals.size - CAST(full_size AS DOUBLE)) / CAST(totals.weight - full_weight AS DOUBLE)) AS level FROM filled, totals
), targets AS (
    SELECT source, source_size, CASE WHEN totals.size > 0 THEN least(CAST(2 * source_size AS DOUBLE), level * CAST(weighed.weight AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS target
    FROM weighed, level, totals
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate,
           CAST(CAST('0x' || substr(md5('20240817:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS coin
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""


@query("op8_mixing", _OP8_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.repetitions(table(spark, sf_dir, "documents"))
    return counted.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_OP9_SQL = r"""
WITH normal AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal FROM documents
), named AS (
    SELECT doc_id, sha256(normal) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size
    FROM normal WINDOW w AS (PARTITION BY normal ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM named
"""


@query("op9_exact_dedup", _OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


_OP10_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n
    FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL)
), runs AS (
    SELECT doc_id, n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS shingle FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sets AS (
    SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL
    UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM words WHERE n < 4 GROUP BY doc_id
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * both_ >= 85 * (s.n + t.n - both_)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


@query("op10_jaccard_join", _OP10_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


_OP11_SQL = rf"""
WITH texts AS (
    SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
), words AS (
    SELECT doc_id, target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), vocabulary AS (
    SELECT word, {_crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words)
), features AS (
    SELECT doc_id, target, bucket, count(*) AS n FROM words JOIN vocabulary USING (word) GROUP BY doc_id, target, bucket
), counts AS (
    SELECT bucket, sum(CASE WHEN target = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN target = 1 THEN n ELSE 0 END) AS t FROM features GROUP BY bucket
), totals AS (
    SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts
), gains AS (
    SELECT bucket, CAST(floor(CAST(1000 AS DOUBLE) * ln(CAST(t + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM features JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id
), weighed AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
           CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) AS h
    FROM documents d LEFT JOIN weights ON d.doc_id = weights.doc_id
), scored AS (
    SELECT doc_id, n_features, weight, weight + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM ranked
"""


@query("op11_importance_resampling", _OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


@query("op12_byte_network")
def op12_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    net = byte_network.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = byte_network.score(docs, net, ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them with an end that repeats itself: by their id's checksum h, words
    from number a = h/10 mod n on repeat with a period of 1 + (n - a) / (3 + h/10 mod 8)."""
    g = F.floor(F.col("h") / 10)

    def changed(words):
        n, a = F.col("n"), F.col("a")
        period = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % period).cast("int"))))

    chosen = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    numbered = chosen.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", g)
    numbered = numbered.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    return numbered.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed(F.col("words")), " ")).otherwise(F.col("text")).alias("text"))


_OP13_SQL = rf"""
WITH split AS (
    SELECT doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, CAST(coalesce(len(words), 0) AS BIGINT) AS n, words FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents)
), placed AS (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n ELSE n END AS a, h // 10 % 8 AS g8 FROM split
), words AS (
    SELECT doc_id, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g8)) END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM placed WHERE n > 0)
), windows AS (
    SELECT doc_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w || ' ' || lead(word, 5) OVER w AS six
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), apart AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i
), islands AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM apart) GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length
), digests AS (
    SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(start := start, length := length, period := period), struct_pack(l := length, s := -start, p := -period)) AS best,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN digests ON digests.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op13_periodic_runs", _OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digested = found.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.period")
    exponent = F.floor(1000 * F.col("best.length") / period).alias("exponent_milli")
    return digested.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", period.alias("period"), exponent, "runs_sha256", "collapsed_sha256")
