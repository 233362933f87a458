"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of KERNEL bytes run over the whole text with a stride of STEP bytes.
Their responses are max-pooled over chunks of 2 * BLOCK filter positions, each overlapping the next
by half, so that the chunks cover the whole document. The mean and the maximum of the chunks' pooled
responses are combined by a logistic unit into one probability.

Fitted on a bounded sample of labelled rows (sample_rows, sample_longest); every whole text is
scored. Edge cases: a null or empty text is one chunk of padding; without labels, or with one class
only, the score is the share of label 1 (0 without labels); null ids keep their row and are not held
out; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import by_value
from .learning import labelled_sample, score_texts, sigmoid

by_value(__name__)

KERNEL, STEP, BLOCK = 8, 2, 64
EMBED, FILTERS = 8, 24
#: Blocks convolved at once: bounds memory for texts of any length.
BLOCKS_AT_ONCE = 1024


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # KERNEL * EMBED x FILTERS
    offset: np.ndarray  # FILTERS
    combine: np.ndarray  # 2 * FILTERS
    bias: float


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each padded by zeros to whole blocks, and the first block of each.

    A text has as many zeros before it as the last filter of a block reaches beyond its end, so that
    none sees the next text.
    """
    span = BLOCK * STEP
    blocks = np.array([max(1, -(-(len(t) + KERNEL - STEP) // span)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(starts[-1]) * span + KERNEL, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        at = s * span + KERNEL - STEP
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return out, starts


def _columns(model: Model, data: np.ndarray, blocks: int) -> np.ndarray:
    """Embedded bytes under every filter position, one row a position."""
    e = np.ascontiguousarray(model.embed[data])
    s = e.strides[0]
    return np.lib.stride_tricks.as_strided(e, (blocks * BLOCK, KERNEL * EMBED), (STEP * s, e.strides[1]))


def block_maxima(model: Model, data: np.ndarray, blocks: int) -> np.ndarray:
    """The largest response of each filter in every block, not below zero."""
    out = np.empty((blocks, FILTERS), np.float32)
    span = BLOCK * STEP
    for at in range(0, blocks, BLOCKS_AT_ONCE):
        n = min(BLOCKS_AT_ONCE, blocks - at)
        response = np.ascontiguousarray(_columns(model, data[at * span : (at + n) * span + KERNEL], n)) @ model.filters
        out[at : at + n] = response.reshape(n, BLOCK, FILTERS).max(1)
    return np.maximum(out + model.offset, 0)


def pooled(maxima: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every document's mean and maximum over its chunks, and the chunks."""
    follow = np.arange(len(maxima)) + 1
    follow[starts[1:] - 1] -= 1  # a document's last block has no next one
    chunks = np.maximum(maxima, maxima[follow])
    counts = np.diff(starts)
    mean = np.add.reduceat(chunks, starts[:-1], axis=0) / counts[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunks, starts[:-1], axis=0)], axis=1), chunks


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.3, (256, EMBED)).astype(np.float32),
        rng.normal(0, (KERNEL * EMBED) ** -0.5, (KERNEL * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS, np.float32),
        0.0,
    )
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        model.bias = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -40, 40))
        return model
    y = labels.astype(np.float32)
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    model.combine = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    names = ("embed", "filters", "offset", "combine")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            data, starts = layout([texts[i] for i in rows])
            n = int(starts[-1])
            columns = _columns(model, data, n)
            response = (np.ascontiguousarray(columns) @ model.filters).reshape(n, BLOCK, FILTERS)
            where = response.argmax(1)  # block x filter
            maxima = np.maximum(np.take_along_axis(response, where[:, None], 1)[:, 0] + model.offset, 0)
            z, chunks = pooled(maxima, starts)
            error = (sigmoid(z @ model.combine + model.bias) - y[rows]) / len(rows)
            grad_z = error[:, None] * model.combine
            # back through the maximum over chunks, the mean, and the maximum of two blocks
            doc = np.repeat(np.arange(len(rows)), np.diff(starts))
            top = chunks == z[doc, FILTERS:]
            grad_chunk = grad_z[doc, :FILTERS] / np.diff(starts)[doc, None] + top * grad_z[doc, FILTERS:]
            follow = np.arange(n) + 1
            follow[starts[1:] - 1] -= 1
            own = maxima >= maxima[follow]
            grad_block = np.where(own, grad_chunk, 0)
            np.add.at(grad_block, follow, np.where(own, 0, grad_chunk))
            grad_block *= maxima > 0
            position = where + (np.arange(n) * BLOCK)[:, None]
            grads = {"combine": z.T @ error + 1e-4 * model.combine, "offset": grad_block.sum(0)}
            grads["filters"] = np.empty_like(model.filters)
            grads["embed"] = np.zeros_like(model.embed)
            for f in range(FILTERS):
                live = np.flatnonzero(grad_block[:, f])
                g = grad_block[live, f].astype(np.float32)
                at_bytes = position[live, f] * STEP
                grads["filters"][:, f] = columns[position[live, f]].T @ g
                under = data[at_bytes[:, None] + np.arange(KERNEL)]  # bytes below the filter
                back = g[:, None, None] * model.filters[:, f].reshape(KERNEL, EMBED)
                np.add.at(grads["embed"], under, back)
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k in names:
                g = grads[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(model, k, getattr(model, k) - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            model.bias -= pace * float(error.sum())
    return model


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; texts are laid out a few at a time."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 20):
            size += len(texts[end])
            end += 1
        data, starts = layout(texts[at:end])
        z, _ = pooled(block_maxima(model, data, int(starts[-1])), starts)
        out[at:end] = sigmoid(z.astype(np.float64) @ model.combine + model.bias)
        at = end
    return out


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, left_out: int = 0, threshold: float = 0.3, sample_rows: int = 3000, sample_longest: int = 10_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(*labelled_sample(docs, labels, label, modulus, left_out, sample_rows, sample_longest))
    return score_texts(docs, score, model, modulus, left_out, threshold)
