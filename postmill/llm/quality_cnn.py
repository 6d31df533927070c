"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

A document's bytes are cut into chunks that overlap by the filters' width less one, so that every window
of the whole text is seen once. In each chunk every filter keeps its highest response; the responses of
the chunks are averaged, and a logistic unit turns the average into one probability. A filter is a table
of weights by place and byte, so a response is a sum of table look-ups.

It is fitted on a bounded sample of labelled documents on the driver; scoring runs in Arrow batches and
holds a bounded number of bytes at a time, however long a text is.

Defined cases: null and empty texts are one chunk of zero bytes and get the probability of that; null
labels and labels other than 0 and 1 are left out; without rows of both labels the score is 0.5;
repeated rows score alike; an empty table gives no rows; columns other than key and text play no part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.arrowtext import text_bytes
from postmill.llm.common import hash_sample

WIDTH, FILTERS, CHUNK = 4, 16, 512
#: Window responses that are held at once.
WINDOWS = 1 << 17


class Network(NamedTuple):
    table: np.ndarray  # place, byte, filter
    shift: np.ndarray  # filter
    weight: np.ndarray  # filter
    intercept: float


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """Response of each filter at each window start; ``data`` has WIDTH - 1 bytes more than there are windows."""
    n = len(data) - WIDTH + 1
    out = net.table[0][data[:n]]
    for j in range(1, WIDTH):
        out += net.table[j][data[j : j + n]]
    return out


def chunk_bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last window of every chunk; a text of n bytes has max(1, n - WIDTH + 1) windows."""
    windows = np.maximum(lengths - WIDTH + 1, 1)
    chunks = -(-windows // CHUNK)
    doc = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = number * CHUNK
    return doc, first, np.minimum(first + CHUNK, windows[doc])


def chunk_features(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, highest responses) of every chunk, a bounded number of windows at a time."""
    lengths = np.diff(offsets)
    doc, first, last = chunk_bounds(lengths)
    pooled = np.empty((len(doc), FILTERS), np.float32)
    sizes = last - first
    ends = np.cumsum(sizes)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + WINDOWS, "right")))
        # bytes of all windows of these chunks, each chunk with its overlap; short texts are filled with 0
        size = sizes[at:to] + WIDTH - 1
        starts = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(starts - first[at:to], size)
        owner = np.repeat(doc[at:to], size)
        inside = place < lengths[owner]
        buffer = np.zeros(len(place), np.uint8)
        buffer[inside] = data[offsets[owner[inside]] + place[inside]]
        got = responses(net, np.concatenate([buffer, np.zeros(WIDTH - 1, np.uint8)]))
        # the last WIDTH - 1 starts of a chunk's bytes reach into the next chunk: they repeat its best window's lower bound
        reach = np.arange(len(buffer)) - np.repeat(starts, size) >= np.repeat(sizes[at:to], size)
        got[reach] = -np.inf
        pooled[at:to] = np.maximum.reduceat(got, starts, axis=0)
        at = to
    return doc, pooled


def document_features(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, pooled = chunk_features(net, data, offsets)
    active = np.maximum(pooled + net.shift, 0)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    return np.add.reduceat(active, np.cumsum(counts) - counts, axis=0) / counts[:, None]


def probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    features = document_features(net, *text_bytes(texts))
    return 1 / (1 + np.exp(-(features @ net.weight + net.intercept).astype(float)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on the logistic loss, both labels weighing the same; gradients flow through each chunk's best
    window. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    params = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "shift": np.zeros(FILTERS, np.float32),
        "weight": rng.normal(0, 0.3, FILTERS).astype(np.float32), "intercept": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            step += 1
            _descend(params, moments, [texts[i] for i in order[at : at + batch]], labels[order[at : at + batch]], balance[order[at : at + batch]], rate, step)
    return Network(params["table"], params["shift"], params["weight"], float(params["intercept"][0]))


def _descend(params: dict, moments: dict, texts: list[bytes], y: np.ndarray, balance: np.ndarray, rate: float, step: int) -> None:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc, first, last = chunk_bounds(np.diff(offsets))
    # windows of equal chunks as a block; windows beyond a chunk's end are masked
    place = first[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = place < np.diff(offsets)[doc][:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    block = np.where(inside, padded[np.where(inside, offsets[doc][:, None] + place, len(data))], 0)
    got = params["table"][0][block[:, :CHUNK]]
    for j in range(1, WIDTH):
        got += params["table"][j][block[:, j : j + CHUNK]]
    got[np.arange(CHUNK) >= (last - first)[:, None]] = -np.inf
    best = got.argmax(axis=1)
    pooled = np.take_along_axis(got, best[:, None, :], axis=1)[:, 0] + params["shift"]
    chunks = np.bincount(doc, minlength=len(texts))
    features = np.add.reduceat(np.maximum(pooled, 0), np.cumsum(chunks) - chunks, axis=0) / chunks[:, None]
    error = (1 / (1 + np.exp(-(features @ params["weight"] + params["intercept"][0]))) - y) * balance / len(texts)
    back = (error[doc] / chunks[doc])[:, None] * params["weight"] * (pooled > 0)
    grads = {"weight": features.T @ error, "intercept": np.array([error.sum()]), "shift": back.sum(axis=0), "table": np.zeros_like(params["table"])}
    rows, filters = np.arange(len(doc))[:, None], np.arange(FILTERS)
    for j in range(WIDTH):
        np.add.at(grads["table"][j], (block[rows, best + j], filters[None, :]), back)
    for k, g in grads.items():
        m, v = moments[k]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def fit_quality(
    docs: DataFrame, labels: DataFrame, per_label: int = 600, max_bytes: int = 16_384, key: str = "doc_id", text: str = "text", label: str = "quality", **training: float
) -> Network:
    """Fit on at most ``per_label`` documents of each label, chosen by hash among those of at most
    ``max_bytes`` bytes, so that the driver holds 2 * per_label * max_bytes bytes at most. The ids are
    sampled from the label table (twice as many, for the long texts to be left out); that sample is what is broadcast."""
    usable = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    sample = hash_sample(usable.where("_y = 0"), "_key", 2 * per_label).unionAll(hash_sample(usable.where("_y = 1"), "_key", 2 * per_label))
    short = docs.where(F.octet_length(text) <= max_bytes).select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"))
    found = short.join(F.broadcast(sample), F.col("_id") == F.col("_key"))
    by_hash = F.xxhash64(F.col("_key").cast("string"), F.lit(7))
    got = [found.where(f"_y = {y}").orderBy(by_hash, "_text").limit(per_label).select("_text", "_y").collect() for y in (0, 1)]
    if not all(got):
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)
    rows = [r for part in got for r in part]
    return train([bytes(r["_text"]) for r in rows], np.array([r["_y"] for r in rows], float), **training)


def quality_score(text: Column, net: Network) -> Column:
    """Probability that a text is of label 1. The network (about 70 kB) travels with the function."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(net, texts), pa.float64())

    return score(text)
