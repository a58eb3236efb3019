import json
import os

from pyspark.sql import functions as F

from claimweave.plans import source_queries
from claimweave.session import scratch_path
from claimweave.sources import readers, writers


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, content in files.items():
        mode = "wb" if isinstance(content, bytes) else "w"
        with open(os.path.join(folder, name.replace("__", ".")), mode) as handle:
            handle.write(content)


def test_page_texts(spark):
    folder = scratch_path(spark, "pages")
    write(folder, **{"policy__v2__json": json.dumps(["one\ntwo", "three"]), "odd__json": '{"a": 1}', "skip__txt": '["x"]'})
    rows = {(r["source"], r["text_index"], r["text"]) for r in readers.read_page_texts(spark, folder).collect()}
    assert rows == {("policy.v2", 0, "one\ntwo"), ("policy.v2", 1, "three")}


def test_page_texts_by_line(spark):
    folder = scratch_path(spark, "page_lines")
    write(folder, many__json="\n".join([json.dumps(["one\ntwo", "three"]), '{"a": 1}', json.dumps(["four", None])]))
    rows = sorted(((r["source"], r["text_index"], r["text"]) for r in readers.read_page_texts(spark, folder, lines=True).collect()), key=str)
    assert rows == [("many", 0, "four"), ("many", 0, "one\ntwo"), ("many", 1, "three"), ("many", 1, None)]


def test_page_texts_need_few_files(spark, monkeypatch):
    """Conversations share files but for every fiftieth; NULL and odd texts, and a NULL conversation, come back as they were."""
    texts = ["a\tb", "", None, "two\r\nlines\u2028", '"q" \\']
    turns = [(i if i < 299 else None, t, text) for i in range(300) for t, text in enumerate(texts)]
    folder, path = scratch_path(spark, "few"), scratch_path(spark, "few_texts")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").write.parquet(f"{folder}/conversations.parquet")
    monkeypatch.setattr(source_queries, "scratch_path", lambda *_: path)
    found = source_queries.REGISTRY.queries["a02_read_page_texts"](spark, folder).collect()
    assert all(r["named_by_file"] for r in found)
    assert sorted(((r["conv_id"], r["text_index"], r["text"]) for r in found), key=str) == sorted(turns, key=str)
    assert len([f for _, _, files in os.walk(path) for f in files if f.startswith("part-") and f.endswith(".txt")]) <= 6 + 8


def test_batches_and_json(spark):
    folder = scratch_path(spark, "batches")
    write(folder, **{"batch_1__json": '{"id": "a", "v": 1}\n{"id": "b", "v": 1}\n', "batch_2__json": '{"id": "a", "v": 2}\n'})
    assert {(r["id"], r["v"]) for r in readers.merge_batches(spark, folder, "id string, v int").collect()} == {("a", 2), ("b", 1)}
    both = scratch_path(spark, "json")
    write(both, **{"list__json": '[{"id": 1},\n {"id": 2}]', "one__json": '{"id": 3}'})
    found = readers.concat_json(spark, [f"{both}/list.json", f"{both}/one.json"], "id int")
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 3]


def test_taxonomy(spark):
    folder = scratch_path(spark, "taxonomy")
    document = {
        "taxonomy_name": "t", "products": ["p"],
        "layers": {"layer_2_benefits": [{"benefit_name": "b", "parameters": ["x"], "products": {"p": {"benefit_exist": True, "extra": {"deep": 1}}}}]},
        "metadata": {"version": "1.0"},
    }
    write(folder, good__json=json.dumps(document, indent=1), bad__json='{"taxonomy_name": ')
    documents = readers.read_taxonomy(spark, folder)
    assert sorted(r["taxonomy_name"] is None for r in documents.collect() if r["_corrupt_record"]) == [True]
    item = readers.taxonomy_layer(documents, "layer_2_benefits").first()
    assert item["benefit_name"] == "b" and json.loads(item["products"]["p"])["extra"] == {"deep": 1}


def test_graph(spark):
    folder = scratch_path(spark, "graph")
    graph = {"nodes": [{"id": "1", "memory": "m", "metadata": {"created_at": "2020"}}, {"id": "2"}], "edges": [{"source": "1", "target": "2"}, {"source": "2", "target": "1", "type": "PARENT", "created_at": "2021"}]}
    write(folder, graph__json=json.dumps(graph, indent=1))
    nodes, edges = readers.read_graph(spark, folder, "now")
    assert {(r["id"], r["memory"], r["created_at"], r["updated_at"]) for r in nodes.collect()} == {("1", "m", "2020", "now"), ("2", "", "now", "now")}
    assert {(r["type"], r["created_at"]) for r in edges.collect()} == {("RELATED_TO", "now"), ("PARENT", "2021")}


def test_files(spark):
    folder = scratch_path(spark, "files")
    write(folder, **{"a__txt": "grüße", "b__md": b"caf\xe9", "c__png": b"\x89PNG", "d__txt": "x" * 3000})
    rows = {os.path.basename(r["path"]): (r["category"], r["text"], r["error"]) for r in readers.ingest_files(spark, folder, max_mb=0.002).collect()}
    assert rows == {
        "a.txt": ("text", "grüße", None), "b.md": ("text", "café", None), "c.png": ("image", None, "no reader for image"), "d.txt": ("text", None, "file too large")
    }


def test_encodings(spark):
    folder = scratch_path(spark, "encodings")
    os.makedirs(folder)
    for name, data in {"a.txt": "\ufeffdrei Wörter hier".encode("utf-16-le"), "b.txt": b"\xfe\xff" + "zwei Wörter".encode("utf-16-be"), "c.txt": "ein Wörtchen mehr".encode("latin-1")}.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data)
    rows = {os.path.basename(r["path"]): (r["text"], r["encoding"], r["language"], r["word_count"]) for r in readers.ingest_files(spark, folder).collect()}
    assert rows == {
        "a.txt": ("drei Wörter hier", "utf-16", "en", 3), "b.txt": ("zwei Wörter", "utf-16", "en", 2), "c.txt": ("ein Wörtchen mehr", "iso-8859-1", "en", 3)
    }


def test_csv(spark):
    folder = scratch_path(spark, "csv")
    write(folder, a__csv='id,"na, me"\n1,\n2,"say ""hi"""\n')
    lines, counts = readers.csv_text(spark, folder)
    assert sorted(r["line"] for r in lines.collect()) == ["1\t", '2\tsay "hi"', "id\tna, me"]
    assert counts.first().asDict() == {"row_count": 3, "col_count": 2}
    tabs = scratch_path(spark, "tsv")
    write(tabs, a__tsv="a\tb\n")
    assert readers.csv_text(spark, tabs, "\t")[0].first()["line"] == "a\tb"


def test_upsert(spark):
    target = spark.createDataFrame([(1, "old", "t0", "t0"), (2, "keep", "t0", "t1")], "id int, v string, created_at string, updated_at string")
    source = spark.createDataFrame([(1, "first", 1), (1, None, 2), (3, "new", 1)], "id int, v string, seq int")
    rows = {tuple(r) for r in writers.upsert(target, source, ["id"], "seq", F.lit("now")).collect()}
    assert rows == {(1, None, "t0", "now"), (2, "keep", "t0", "t1"), (3, "new", "now", "now")}


def test_partitioned_write_and_fixed_schema(spark):
    path = scratch_path(spark, "claims")
    rows = spark.range(10).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in readers.CLAIMS_SCHEMA.fields]).withColumn("loss_type", F.lit("medical"))
    writers.write_table(rows, path, ["loss_type"])
    back = readers.read_claims(spark, path)
    assert back.count() == 10 and back.filter("loss_type = 'medical'").count() == 10
    plan = back.filter("claim_number = 'x'").select("claim_number", "net_paid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(claim_number), EqualTo(claim_number,x)]" in plan and "gross_paid" not in plan


def test_upsert_in_place_leaves_other_partitions(spark):
    from pathlib import Path

    path = scratch_path(spark, "in-place")
    names = lambda: {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(path).glob("*/*.parquet")}
    first = spark.createDataFrame([(i, f"v{i}", 1) for i in range(40)] + [(None, "none", 1)], "id int, v string, seq int")
    part = F.expr("id div 10")
    writers.upsert_in_place(spark, path, first, ["id"], "seq", F.lit("t1"), part)  # creates the table
    before = names()
    changes = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (35, None, 1), (99, "far", 1)], "id int, v string, seq int")
    writers.upsert_in_place(spark, path, changes, ["id"], "seq", F.lit("t2"), part)
    after = names()
    assert {k for k in after if after.get(k) != before.get(k)} == {"part=0", "part=3", "part=9"}
    rows = {r.id: (r.v, r.created_at, r.updated_at) for r in spark.read.parquet(path).collect()}
    want = {i: (f"v{i}", "t1", "t1") for i in range(40)} | {None: ("none", "t1", "t1"), 3: ("new", "t1", "t2"), 35: (None, "t1", "t2"), 99: ("far", "t2", "t2")}
    assert rows == want


def test_upsert_in_place_writes_a_file_per_partition(spark):
    """Rows of one partition come together, however many tasks the join has."""
    from pathlib import Path

    path = scratch_path(spark, "few-files")
    rows = spark.createDataFrame([(i, f"v{i}", 1) for i in range(400)], "id int, v string, seq int")
    for stamp in ("t1", "t2"):
        writers.upsert_in_place(spark, path, rows, ["id"], "seq", F.lit(stamp), F.expr("id div 100"))
        assert [len(list(p.glob("*.parquet"))) for p in Path(path).glob("part=*")] == [1] * 4
