import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from claimweave.functions import lookups
from claimweave.functions import text as fn
from claimweave.operators import documents as ops

ALPHABET = "aZ0l19 .!?\n\r\t-|━•…   \x1c\x85éß中文カ한عЖ0A​\x07'_"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["", " ", "\n\n\n", "a-\nb", "0A l5 x0A él5", "One. Two? three! Four.Five.  Six", "a\n \n\nb"]
    for _ in range(400):
        out.append("".join(rng.choice(ALPHABET) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(0, 60))))
    return out


def apply(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def squeezed(t):
    t = re.sub("  +", " ", t)
    t = re.sub("\n\n+", "\n\n", t)
    return "\n".join(line.strip() for line in t.split("\n"))


def test_normalize(spark, texts):
    assert apply(spark, texts, fn.normalize_ws("t")) == [squeezed(t) for t in texts]


def test_clean(spark, texts):
    def clean(t):
        t = re.sub("[|┃│║]", " ", squeezed(t))
        t = re.sub("[─━═]", "-", t)
        t = re.sub("[•‣⁃]", "•", t).replace("…", "...")
        t = re.sub(r"\b0(?=[A-Z])", "O", t)
        t = re.sub(r"\bl(?=\d)", "1", t)
        t = "".join(c for c in t if c in "\n\t" or unicodedata.category(c)[0] != "C")
        return "\n".join(line.rstrip() for line in t.split("\n")).strip()

    assert apply(spark, texts, fn.clean_text("t")) == [clean(t) for t in texts]


def test_lines_and_counts(spark, texts):
    assert apply(spark, texts, fn.extract_lines("t", 2)) == [[s.strip() for s in t.split("\n") if len(s.strip()) >= 2] if t else [] for t in texts]
    stats = apply(spark, texts, fn.text_stats("t"))
    for t, s in zip(texts, stats):
        blank = lambda parts: sum(1 for p in parts if p.strip())
        assert (s["char_count"], s["word_count"], s["line_count"], s["paragraph_count"]) == (
            len(t), len(t.split()), blank(t.split("\n")), blank(t.split("\n\n"))
        )


def test_small_functions(spark, texts):
    assert apply(spark, texts, fn.fix_hyphenation("t")) == [re.sub(r"(\w)-\n(\w)", r"\1\2", t) for t in texts]
    assert apply(spark, texts, fn.truncate("t", 10)) == [t if len(t) <= 10 else t[:7] + "..." for t in texts]
    assert apply(spark, texts, fn.truncate("t", 2)) == [t if len(t) <= 2 else t[: 2 - 3] + "..." for t in texts]
    assert apply(spark, ["a\na\nb\na", "", "x\n\n\ny"], fn.drop_repeated_lines("t")) == ["a\nb\na", "", "x\n\ny"]
    blocks = F.array(F.lit("  a  b "), F.lit(" "), F.col("t"))
    assert apply(spark, ["\nc\n\n\nd", " "], fn.merge_blocks(blocks)) == ["a b\n\nc\n\nd", "a b"]


def split(t):
    flat = re.sub(r"\s+", " ", t).strip()
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", flat) if s.strip()]


def test_sentences(spark, texts):
    assert apply(spark, texts, fn.sentences("t")) == [split(t) for t in texts]


def test_language(spark):
    samples = ["short", "plain english words", "中文字符中文字符中文", "カタカナカタカナカタカナ", "한국어한국어한국어한국", "العربية العربية", "Русский язык", "[\\]^_`[\\]^_`", "abcde中文字符中"]
    assert apply(spark, samples, fn.script_language("t")) == ["en", "en", "ch", "japan", "korean", "ar", "ru", "en", "en"]


def test_responses(spark):
    samples = ['```json\n{"a": 1, "b": 2}\n```', "'{\"a\": 1, \"b\": null}'", 'Here: {"a": 1} ok', "", None, '{"a": 1, "b"', "``{\"a\":1,\"b\":2}``", "5"]
    errors = [r["error_type"] for r in apply(spark, samples, fn.parse_response("t", ["a", "b"]))]
    assert errors == [None, None, "missing_keys: b", "empty_response", "empty_response", "json_decode_error", None, "missing_keys: a,b"]
    arrays = [r["error_type"] for r in apply(spark, ["x [1, 2] y", '{"a": 1}', " ", "[1"], fn.parse_array_response("t"))]
    assert arrays == [None, "not_an_array", "empty_response", "json_decode_error"]


def test_detections(spark):
    text = "top<|ref|> Image <|/ref|><|det|>[[0, 0, 999, 999], [10, 20, 500.5, -3], [1, 2]]<|/det|> \\coloneqq end<｜end▁of▁sentence｜> "
    found = apply(spark, [text, "none"], fn.detections("t", F.lit(100), F.lit(200)))
    assert [(d["label"], d["boxes"]) for d in found[0]] == [("Image", [[0, 0, 100, 200], [1, 4, 50, 0]])]
    assert found[1] == []
    assert apply(spark, [text], fn.strip_detections("t")) == ["top := end"]


def test_lookups(spark):
    assert apply(spark, ["Greece", "GR", " greece ", "UK", "Unknown", None, "viet nam"], lookups.normalize_country("t")) == ["GR", "GR", "GR", "GB", None, None, "VT"]
    names = ["a.txt", "/x/b.TAR.GZ", "b.tar.gz", "c.JPG", "noext", ".bashrc", "x.css", "y.unknownext", "d.7z"]
    assert apply(spark, names, lookups.file_category("t")) == ["text", "archive", "archive", "image", "unknown", "unknown", "text", "unknown", "archive"]


def rebuilt(units, size, overlap, minimum):
    """Packing by plain slices: a chunk is a run of sentences after an optional tail."""
    chunks, current = [], []
    for unit in units:
        if current and sum(map(len, current)) + len(unit) > size:
            chunks.append(" ".join(current))
            keep = 0
            while keep < len(current) and sum(map(len, current[len(current) - keep - 1 :])) <= overlap:
                keep += 1
            tail = " ".join(current[len(current) - keep :])
            current = [tail] if tail else []
        current.append(unit)
    if current:
        chunks.append(" ".join(current))
    return [c for c in chunks if len(c) >= minimum]


def test_chunks(spark):
    rng = random.Random(9)
    documents = ["", "Tiny.", "W" * 1500 + ". Next one is here."]
    for _ in range(60):
        documents.append(" ".join("X" + "y" * rng.randint(0, rng.choice([20, 90, 400])) + rng.choice(".!?") for _ in range(rng.randint(1, 40))))
    df = spark.createDataFrame(list(enumerate(documents)), "doc int, text string").repartition(4)
    for size, overlap, minimum in ((1000, 200, 100), (120, 50, 30), (60, 200, 0)):
        rows = ops.chunk(df, ["doc"], "text", size, overlap, minimum, {"document_type": "policy_wording"}).collect()
        mine = {}
        for r in sorted(rows, key=lambda r: (r["doc"], r["chunk_index"])):
            assert r["char_count"] == len(r["text"]) and r["metadata"] == {"document_type": "policy_wording"}
            mine.setdefault(r["doc"], []).append(r["text"])
        assert mine == {i: c for i, t in enumerate(documents) if (c := rebuilt(split(t), size, overlap, minimum))}


def test_pages_in_parts(spark):
    pages = [("d", i, f" text {i} ![](images/{i}.jpg) ") for i in range(25)] + [("e", 0, "only")]
    df = spark.createDataFrame(pages, "doc string, page int, markdown string").repartition(3)
    whole = {r["doc"]: r["text"] for r in ops.assemble_pages(df, "doc").collect()}
    parts = {}
    for r in sorted(ops.assemble_pages(df, "doc", per_part=7).collect(), key=lambda r: r["part"]):
        parts[r["doc"]] = parts.get(r["doc"], "") + r["text"]
    assert parts == whole
    assert whole["e"] == "# e\n---\n\n\n## Page 1\n\nonly\n"
    assert "## Page 13\n\ntext 12 ![](page-012/images/12.jpg)\n" in whole["d"]
    sections = df.withColumn("markdown", F.when(F.col("page") % 5 != 0, F.col("markdown")).otherwise(" "))
    joined = {r["doc"]: r["text"] for r in ops.join_sections(sections, "doc", "page", "markdown").collect()}
    split_up = {}
    for r in sorted(ops.join_sections(sections, "doc", "page", "markdown", per_part=4).collect(), key=lambda r: r["part"]):
        split_up[r["doc"]] = split_up.get(r["doc"], "") + r["text"]
    assert split_up == joined and joined["d"].count("\n\n") == 19


def test_page_arrays_and_confidence(spark):
    df = spark.createDataFrame([("d", 0, "a"), ("d", 3, "b"), ("e", 1, None)], "doc string, page int, text string")
    assert {r["doc"]: r["pages"] for r in ops.page_array(df, "doc").collect()} == {"d": ["a", "", "", "b"], "e": ["", ""]}
    lines = spark.createDataFrame([("d", 0, i, f"l{i}", i / 10) for i in range(10)], "doc string, page int, line_no int, text string, confidence double")
    whole = ops.page_confidence(lines).first()
    assert whole["text"] == "\n".join(f"l{i}" for i in range(10)) and abs(whole["average_confidence"] - 0.45) < 1e-12
    parts = ops.page_confidence(lines, per_part=4).orderBy("part").collect()
    assert "\n".join(p["text"] for p in parts) == whole["text"]
    assert all(abs(p["average_confidence"] - 0.45) < 1e-12 for p in parts)


def test_samples(spark):
    rows = [(d, i, f"{d}{i}") for d, n in (("a", 1), ("b", 2), ("c", 3), ("d", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc string, text_index int, text string")
    picked = {}
    for r in ops.sample_positions(df, "doc").collect():
        picked.setdefault(r["doc"], set()).add(r["text_index"])
    assert picked == {"a": {0}, "b": {0, 1}, "c": {0, 1, 2}, "d": {0, 4, 7}}
