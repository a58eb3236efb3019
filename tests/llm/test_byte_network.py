"""The byte network: responses against plain loops, gradients against differences, held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import byte_network as net
from claimweave.llm.language_id import held_out
from claimweave.llm.queries import QUERIES
from tests.llm.messy import LONG, ROWS, empty, frame


def brute_probability(n, text):
    """Every chunk, every place, every filter, one by one."""
    step = net.CHUNK - net.OVERLAP
    responses, begin = [], 0
    while True:
        chunk = text[begin : begin + net.CHUNK].ljust(net.CHUNK, b"\0")
        best = [max(sum(n.filters[k, chunk[t + k], f] for k in range(net.WIDTH)) for t in range(net.CHUNK - net.WIDTH + 1)) for f in range(net.FILTERS)]
        responses.append(np.tanh(np.array(best) + n.bias))
        begin += step
        if begin + net.OVERLAP >= len(text):
            break
    responses = np.array(responses)
    features = np.concatenate([responses.max(axis=0), responses.mean(axis=0)])
    return 1 / (1 + np.exp(-(np.tanh(features @ n.dense + n.dense_bias) @ n.out + n.out_bias[0])))


def test_whole_texts_in_overlapping_chunks():
    n = net.initial(5)
    rng = np.random.default_rng(2)
    texts = [b"", b"x", *[rng.integers(0, 256, size).astype(np.uint8).tobytes() for size in (31, 32, 33, 255, 256, 257, 480, 481, 900)]]
    got = net.probabilities(n, net._paired(n.filters), texts)
    assert np.allclose(got, [brute_probability(n, t) for t in texts], atol=1e-5)
    assert np.allclose(got, [net.probabilities(n, net._paired(n.filters), [t])[0] for t in texts], atol=1e-6)
    buffer, starts, counts = net.chunked(texts)
    for text, count, first in zip(texts, counts, np.cumsum(counts) - counts):
        begin = starts[first]
        assert buffer[begin : begin + len(text)].tobytes() == text and (count - 1) * (net.CHUNK - net.OVERLAP) + net.CHUNK >= len(text)


def test_gradients():
    n = net.Network(*[w.astype(np.float64) for w in net.initial(1)])
    rng = np.random.default_rng(1)
    buffer, starts, counts = net.chunked([rng.integers(32, 90, size).astype(np.uint8).tobytes() for size in (10, 300, 900, 1500)])
    chunks, labels = net._columns(buffer, starts), np.array([0.0, 1, 1, 0])
    _, grads = net.gradients(n, chunks, counts, labels)
    for w, g in zip(n, grads):
        for index in [np.unravel_index(np.abs(g).argmax(), w.shape)]:
            old, values = w[index], []
            for shift in (1e-6, -1e-6):
                w[index] = old + shift
                values.append(net.gradients(n, chunks, counts, labels)[0])
            w[index] = old
            assert abs((values[0] - values[1]) / 2e-6 - g[index]) < 1e-6


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = QUERIES["op12_byte_network"](spark, sf_dir)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(bad) > 5 and len(good) > 20
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(a.score > b.score for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_learns_only_from_the_rest(spark):
    """Neither held-out labels nor other columns matter; equal input gives an equal network."""
    rows = [(i, f"word{i} " * 30 if i % 2 else "### $$$ " * 20, "en", "s") for i in range(80)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    wrong = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("text", F.lit("clash"))
    one = net.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    other = net.learn(docs.repartition(5).withColumn("lang", F.lit("x")), wrong.where(~held_out(F.col("doc_id"))).repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(one, other))
    got = net.score(docs, one).select("row.doc_id", F.col("score").alias("p")).collect()
    assert all((r.p > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (5, 0), (7, 1), (12, 0), (12, 0), (99, 1)], "doc_id bigint, quality int")
    n = net.learn(frame(spark), labels)
    got = net.score(frame(spark), n).select("row.*", F.col("score").alias("p")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.p)
    assert all(len(p) == 1 for p in by_text.values()) and LONG in by_text
    assert net.score(empty(spark), n).count() == 0
    nothing = net.learn(empty(spark), labels)
    assert all(np.array_equal(a, b) for a, b in zip(nothing, net.initial()))
