"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its characters, case of A-Z ignored, each counted once.
A feature's value is its naive Bayes log-count ratio between the classes; a logistic regression on
these values is fitted by gradient descent. Features whose ratio says little get no weight.

Fitted on a bounded sample of labelled rows (sample_rows, sample_longest); every whole text is scored.
Edge cases: a null or empty text holds no n-gram and scores by the bias alone; any label but 0 counts
as 1; without labels, or with one class only, the score is the share of label 1 (0 without labels);
repeated rows score alike; null ids keep their row and are not held out; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import by_value
from .learning import labelled_sample, score_texts, sigmoid

by_value(__name__)

BITS = 18
ORDERS = (4, 6, 8)
_MIX = 0x9E3779B1


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def ngram_hashes(text: bytes, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """Bucket of every n-gram of a UTF-8 text, for each order in characters; a text is framed by spaces."""
    framed = b" " + text.lower() + b" "
    b = np.frombuffer(framed, np.uint8).astype(np.uint32) if framed.isascii() else np.frombuffer(framed.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out, h = [], b
    for n in range(2, max(orders) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in orders:
            out.append((h * np.uint32(_MIX) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _held(text: bytes) -> np.ndarray:
    found = ngram_hashes(text)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 200, penalty: float = 1e-3, least_texts: int = 4, least_ratio: float = 1.5) -> Model:
    """Features in fewer than least_texts texts, or with a smaller log-count ratio, get no weight."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return Model(weights, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -40, 40)))
    y = labels.astype(np.float64)
    rows = [_held(t) for t in texts]
    seen = np.zeros((2, 1 << BITS))
    for r, label in zip(rows, labels, strict=True):
        seen[int(label), r] += 1
    p, q = seen[1] + 0.5, seen[0] + 0.5
    ratio = np.log(p / (y.sum() + 1)) - np.log(q / (len(y) - y.sum() + 1))
    ratio[(seen.sum(0) < least_texts) | (np.abs(ratio) < least_ratio)] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    flat = np.concatenate(rows)
    lengths = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    names, column = np.unique(flat, return_inverse=True)
    value = ratio[flat]
    w, bias = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    weight = np.where(y == 1, (1 - y.mean()) / y.mean(), 1.0)  # both classes weigh alike
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, weights=value * w[column], minlength=len(y)) + bias
        error = (sigmoid(margin) - y) * weight / len(y)
        grad = np.append(np.bincount(column, weights=value * error[owner], minlength=len(names)) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[names] = (w * ratio[names]).astype(np.float32)
    return Model(weights, bias)


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for i, text in enumerate(texts):
        hits = [h[model.weights[h] != 0] for h in ngram_hashes(text)]
        if hits:
            own = np.unique(np.concatenate(hits))
            out[i] += float(model.weights[own].sum(dtype=np.float64))
    return sigmoid(out)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, left_out: int = 0, threshold: float = 0.5, sample_rows: int = 8000, sample_longest: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(*labelled_sample(docs, labels, label, modulus, left_out, sample_rows, sample_longest))
    return score_texts(docs, score, model, modulus, left_out, threshold)
