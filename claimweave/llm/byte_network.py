"""A convolutional network over bytes that scores the quality of a text, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide
over every chunk and are max-pooled inside it; the largest and the mean response over the chunks go
through a small dense layer into one probability. The network learns on the driver, from a
bounded sample of labelled rows; scoring is a map over the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import coin, map_texts

CHUNK = 256
WIDTH = 8  # even: bytes are looked up in pairs
FILTERS = 16
HIDDEN = 16
# A chunk begins so many bytes before the one before it ends, so every window of WIDTH bytes is inside one.
OVERLAP = 32

# The bounds of the sample: rows, and bytes of a sampled text. They also bound the driver's memory.
MAX_ROWS = 3000
MAX_BYTES = 1 << 16

EPOCHS = 6
BATCH = 32
RATE = 0.01
SEED = 20240817
# Chunks scored together.
TOGETHER = 64


class Network(NamedTuple):
    filters: np.ndarray  # WIDTH x 256 x FILTERS: what each byte at each place adds to each filter
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # 2 FILTERS x HIDDEN
    dense_bias: np.ndarray  # HIDDEN
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1


def chunked(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all texts, where in it their chunks begin, and how many each text has (one at least); a short last chunk is filled with zeros."""
    step = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts], np.int64)
    sizes = (counts - 1) * step + CHUNK
    begins = np.cumsum(sizes) - sizes
    buffer = np.zeros(int(sizes.sum()), np.uint8)
    for begin, text in zip(begins.tolist(), texts, strict=True):
        buffer[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
    starts = np.repeat(begins, counts) + step * (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    return buffer, starts, counts


def _columns(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return buffer[np.arange(CHUNK)[:, None] + starts[None, :]]


def _paired(filters: np.ndarray) -> np.ndarray:
    """The filters as tables over pairs of bytes, half as many look-ups."""
    width, _, n = filters.shape
    return (filters[0::2, :, None, :] + filters[1::2, None, :, :]).reshape(width // 2, 65536, n)


def pooled(tables: np.ndarray, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk (chunks x filters)."""
    places = CHUNK - 2 * len(tables) + 1
    out = np.empty((len(starts), tables.shape[2]), np.float32)
    for begin in range(0, len(starts), TOGETHER):
        chunks = _columns(buffer, starts[begin : begin + TOGETHER])
        pairs = chunks[:-1].astype(np.int64) << 8 | chunks[1:]
        total = tables[0].take(pairs[:places], axis=0)
        added = np.empty_like(total)
        for j in range(1, len(tables)):
            tables[j].take(pairs[2 * j : 2 * j + places], axis=0, out=added, mode="clip")
            total += added
        total.max(axis=0, out=out[begin : begin + TOGETHER])
    return out


def _joined(responses: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the largest and the mean response over its chunks, with the starts and owners of the chunks."""
    starts = np.cumsum(counts) - counts
    largest = np.maximum.reduceat(responses, starts, axis=0)
    mean = np.add.reduceat(responses, starts, axis=0) / counts[:, None]
    return np.concatenate([largest, mean], axis=1), starts, np.repeat(np.arange(len(counts)), counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(net: Network, tables: np.ndarray, texts: Sequence[bytes]) -> np.ndarray:
    buffer, starts, counts = chunked(texts)
    features, _, _ = _joined(np.tanh(pooled(tables, buffer, starts) + net.bias), counts)
    return _sigmoid(np.tanh(features @ net.dense + net.dense_bias) @ net.out + net.out_bias[0])


def initial(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return Network(draw(0.15, WIDTH, 256, FILTERS), zeros(FILTERS) - 1, draw((2 * FILTERS) ** -0.5, 2 * FILTERS, HIDDEN), zeros(HIDDEN), draw(HIDDEN**-0.5, HIDDEN), zeros(1))


def gradients(net: Network, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of a batch and its gradient. Only the place where a filter is largest in a chunk passes its share on."""
    width, n = net.filters.shape[0], chunks.shape[1]
    places = len(chunks) - width + 1
    total = net.filters[0].take(chunks[:places], axis=0)
    for k in range(1, width):
        total += net.filters[k].take(chunks[k : k + places], axis=0)
    at = total.argmax(axis=0)
    response = np.tanh(np.take_along_axis(total, at[None], axis=0)[0] + net.bias)
    features, starts, owner = _joined(response, counts)
    hidden = np.tanh(features @ net.dense + net.dense_bias)
    p = _sigmoid(hidden @ net.out + net.out_bias[0])
    loss = float(-np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-9)))

    d_logit = (p - labels) / len(labels)
    d_hidden = np.outer(d_logit, net.out) * (1 - hidden**2)
    d_features = d_hidden @ net.dense.T
    filters = net.filters.shape[2]
    d_response = (d_features[:, filters:] / counts[:, None])[owner]
    top = response == features[owner, :filters]  # chunks that tie share alike
    d_response += top * (d_features[:, :filters] / np.add.reduceat(top, starts, axis=0))[owner]
    d_response *= 1 - response**2
    d_filters = np.empty_like(net.filters)
    column, which = np.arange(n)[:, None], np.arange(filters)[None, :]
    for k in range(width):
        index = chunks[at + k, column].astype(np.int64) * filters + which
        d_filters[k] = np.bincount(index.ravel(), d_response.ravel(), 256 * filters).reshape(256, filters)
    return loss, [d_filters, d_response.sum(axis=0), features.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_logit, np.array([d_logit.sum()])]


def train(texts: Sequence[str], labels: Sequence[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learns from whole texts by Adam, in seeded order; equal input gives an equal network. Without texts the network is as drawn."""
    net = initial(seed)
    if not len(texts):
        return net
    rng = np.random.default_rng(seed)
    data = [t.encode("utf-8", "replace") for t in texts]
    marks = np.array(labels, np.float32)
    # Before anything is learned, the share of the labels.
    share = np.clip(marks.mean(), 0.02, 0.98)
    net.out_bias[0] = np.log(share / (1 - share))
    first, second = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            buffer, starts, counts = chunked([data[i] for i in part])
            _, grads = gradients(net, _columns(buffer, starts), counts, marks[part])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for w, g, m, v in zip(net, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learns ``label`` (0 or 1) of ``labels`` (``doc_id``, ``label``) from the texts of ``docs``.

    The sample is ``max_rows`` rows with a label, drawn by a seeded hash of the id, among texts of
    at most ``max_bytes`` bytes; each is learned whole. Rows without id, text or label teach
    nothing, and of several labels of an id the smallest counts. Only the sample comes to the driver.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"))
    drawn = marked.withColumn("draw", coin(seed, F.col("doc_id")))
    # Some sampled texts may be null or too long: twice the rows are fetched, and the first in draw order stay.
    few = drawn.orderBy("draw", "doc_id").limit(2 * max_rows)
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    rows = texts.join(F.broadcast(few), "doc_id").orderBy("draw", "doc_id", "text").select("text", "label").limit(max_rows).toArrow()
    return train(rows["text"].to_pylist(), rows["label"].to_pylist(), epochs, seed)


def score(docs: DataFrame, net: Network, keep: Sequence[str] | None = None) -> DataFrame:
    """Every document with ``score``, the probability of label 1.

    Only the text is looked at, and all of it. A null text scores as an empty one. Texts that repeat
    score alike. The document's columns (those in ``keep``) stay inside ``row``, so they cannot
    clash; an empty table gives no rows. Nothing is shuffled.
    """
    kept: list[np.ndarray] = []

    def run(texts: list[str | None]) -> list[list[float]]:
        if not kept:
            kept.append(_paired(net.filters))
        scores: list[float] = []
        pending: list[bytes] = []
        size = 0
        for text in texts:
            pending.append((text or "").encode("utf-8", "replace"))
            size += len(pending[-1]) + CHUNK
            if size >= TOGETHER * 16 * CHUNK:
                scores += probabilities(net, kept[0], pending).tolist()
                pending, size = [], 0
        if pending:
            scores += probabilities(net, kept[0], pending).tolist()
        return [scores]

    return map_texts(docs, run, {"score": pa.float64()}, keep)
