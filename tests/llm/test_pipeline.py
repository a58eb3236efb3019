"""The pipeline against the same stages computed by brute force."""

import hashlib
import math

import numpy as np

import corpus_pipeline
from claimweave.llm import language_id, mixing
from tests.llm.messy import POEM, ROWS, frame, words
from tests.llm.test_dedup import brute_components, brute_lines, passages, variants
from tests.llm.test_others import brute_targets, check_pieces

DOCS = [
    *[(r[0] if r[0] is None else 500 + r[0], r[1], r[2], r[3]) for r in ROWS if r[0] is not None],
    *[(i, text, "en", "hot" if i % 3 else "s") for i, text in passages(4, 25)],
    *[(100 + i, text, "en", f"t{i % 4}") for i, text in variants(2, 40)],
]


def brute_fits(model, found, shares):
    """Whether the text is nearer to its languages' own trigrams than to unseen ones, one by one."""
    p, total, value = np.exp(model.log_p), 0, 0.0
    for bucket, n in zip(*found):
        total += n
        value += n * math.log(sum(shares[i] * p[bucket, i] for i in range(len(shares))))
    limit = 0.0
    for i, share in enumerate(shares):
        seen = p[:, i] - min(p[:, i])
        mean = sum(seen * model.log_p[:, i]) / sum(seen)
        spread = math.sqrt(sum(seen * (model.log_p[:, i] - mean) ** 2) / sum(seen))
        limit += share * ((mean + min(model.log_p[:, i])) / 2 - 6 * spread / math.sqrt(total))
    return value / total >= limit


def brute(spark):
    model = language_id.learn_from(frame(spark, DOCS, clash=False))
    rows = []
    for doc_id, text, _, source in DOCS:
        shares = language_id.mixtures(model, [language_id.trigrams(text)])[0]
        found = language_id.trigrams(text)
        if language_id.has_letter(text) and round(float(shares.max()), 6) >= corpus_pipeline.LEAST_SHARE and brute_fits(model, found, shares):
            rows.append((doc_id, text, source))
    kept = brute_lines([(a, b) for a, b, _ in rows])
    rows = [(a, kept[a, b], c) for a, b, c in rows if kept[a, b] == b or words(kept[a, b])]
    groups = brute_components([(a, b) for a, b, _ in rows], corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)
    rows = sorted({r for r, g in zip(rows, groups) if g[0] == g[2]})
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets, mixed = brute_targets(sizes), []
    for doc_id, text, source in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        coin = int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        mixed += [(doc_id, text)] * (math.floor(rate) + (coin < rate - math.floor(rate)))
    return mixed


def test_stages(spark, tmp_path):
    docs = frame(spark, DOCS)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        # Columns that are not the pipeline's own come through as they were.
        assert {r.shard for r in docs.select("shard").distinct().collect()} == {"own shard"}
    want = brute(spark)
    got = docs.select("doc_id", "text", "n_chars").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)
    assert len(want) > 20
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()
    check_pieces(pieces, want, 4096)


def test_copies_leave_no_fragment(spark):
    texts = ["\n".join(f"line {j} of text {i}" for j in range(2 + i % 7)) + "\n" * (i % 2) for i in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(100 + i, t, "en", "s") for i, t in enumerate(texts)] + [(200, "one line only", "en", "s"), (201, "one line only", "en", "s"), (None, texts[3], "en", "s")]
    rows += [(2, texts[2], "en", "s"), (102, texts[2], "en", "s")]
    got = corpus_pipeline.lines(spark, frame(spark, rows), "unused").select("doc_id", "text", "n_chars").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((a, t, len(t)) for a, t in [*enumerate(texts), (2, texts[2]), (200, "one line only"), (201, "one line only")])


def test_language_gate(spark):
    """Neither an unlearned script nor letters without a language pass for one of the learned languages; ordinary texts stay."""
    learned = [(i, f"{POEM} and {i}", "en", "s") for i in range(40)] + [(100 + i, "der Hund und die Katze gehen über die Straße und schlafen dann unter dem Baum", "de", "s") for i in range(40)]
    odd = [(200, "東京は日本の首都であり世界でも有数の大都市である", None, "s"), (201, "xqzjk wvvq zzxk qqpwx vvkjz", None, "s"), (202, "ελληνικά γράμματα χωρίς γλώσσα", None, "s"), (203, "123 ---", None, "s")]
    fine = [(300, "the cat looked at the moon", None, "s"), (301, "moon", None, "s"), (302, "die Katze und the cat", None, "s")]
    kept = corpus_pipeline.language(spark, frame(spark, [*learned, *odd, *fine]), "unused").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in [*learned, *fine])


def test_language_gate_keeps_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, sf_dir).count() == docs.where("text rlike '\\\\p{L}'").count()


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
