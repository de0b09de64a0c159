"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is described by a vector of surface statistics
and encoded by a small layer; a gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, learned from document
labels alone, weighs the passages, and a logistic layer scores the weighted passage representation.

The model is fitted on the driver from all passages of a bounded number of labelled documents (``train_docs``); scoring
covers every passage of every document.

Defined cases: null and blank texts are one empty passage and get a score as well; without usable labels every score
is 0.5, and with labels of one kind only the score is their smoothed share; ids may be null or repeated; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sigmoid, training_sample
from .shingling import U, mix, text_chunks, words
from .tables import slim

PASSAGE = 64  # words
N_CLASSES = 12


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 11, dtype=np.int64)
    kind[128:] = 10
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[32, 9, 11, 12, 13]] = 3
    kind[10] = 4
    kind[[ord(c) for c in ".,;:"]] = 5
    kind[[ord(c) for c in "!?"]] = 6
    kind[ord("|")] = 7
    kind[[ord(c) for c in "#$%&*@^~+=<>/\\_{}[]"]] = 8
    kind[[ord(c) for c in "'\"`-()"]] = 9
    return kind


KIND = _byte_classes()


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and the end)."""
    hashed, at, first = words(data, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(bounds[-1])
    inside = np.arange(total) - np.repeat(bounds[:-1], n_pass)
    word_from = np.repeat(first[:-1], n_pass) + inside * PASSAGE
    word_to = np.minimum(word_from + PASSAGE, np.repeat(first[1:], n_pass))
    owner = np.repeat(np.arange(len(n_pass)), n_pass)
    start = np.where(inside == 0, offsets[:-1][owner], at[np.minimum(word_from, max(0, len(at) - 1))] if len(at) else 0)
    of_byte = np.repeat(np.arange(total), np.diff(np.append(start, len(data))))
    counts = np.bincount(of_byte * N_CLASSES + KIND[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(np.float64)
    size = np.maximum(1, counts.sum(1))
    n = (word_to - word_from).astype(np.float64)
    some = np.maximum(1, n)
    of_word = np.repeat(np.arange(total), (word_to - word_from))

    def distinct(key: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Distinct keys of each group; 40 bits of a key tell the words of a passage apart."""
        packed = np.unique((group.astype(np.uint64) << U(40)) | (key >> U(24)))
        return np.bincount((packed >> U(40)).astype(np.int64), minlength=total)

    unique = distinct(hashed, of_word) if len(hashed) else np.zeros(total)
    same = lambda d: np.bincount(of_word[d:][(hashed[d:] == hashed[:-d]) & (of_word[d:] == of_word[:-d])], minlength=total) if len(hashed) > d else np.zeros(total)
    if len(hashed) > 2:
        inside3 = of_word[2:] == of_word[:-2]
        triple = mix(hashed[:-2] + U(3) * hashed[1:-1] + U(7) * hashed[2:])[inside3]
        group3 = of_word[2:][inside3]
        triples, unique3 = np.bincount(group3, minlength=total), distinct(triple, group3)
    else:
        triples = unique3 = np.zeros(total)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 10]
    columns = [
        counts / size[:, None],
        (counts[:, 1] / np.maximum(1, letters))[:, None], ((size - counts[:, 3] - counts[:, 4]) / some / 10)[:, None], (np.log1p(n) / 4)[:, None],
        (unique / some)[:, None], (same(1) / some)[:, None], ((same(2) + same(3) + same(4)) / some)[:, None], (unique3 / np.maximum(1, triples))[:, None],
        (counts[:, 5] / some)[:, None], (counts[:, 6] / some)[:, None], (counts[:, 7] / some)[:, None], (counts[:, 8] / some)[:, None],
        (np.log1p(np.repeat(n_pass, n_pass)) / 5)[:, None],
    ]
    return np.concatenate(columns, axis=1).astype(np.float32), bounds


N_FEATURES = N_CLASSES + 12


@dataclass
class AttentionModel:
    """Encoder, gated attention and bag score; ``parts`` are the weights, ``mean`` and ``scale`` standardise features."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bounds: np.ndarray):
        p = self.parts
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        starts, n = bounds[:-1], np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        bag = np.add.reduceat(h * a[:, None], starts)
        return z, h, t, g, a, bag, bag @ p["c"] + p["d"]

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return sigmoid(self.forward(x, bounds)[-1])

    @classmethod
    def fit(cls, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        zero = np.zeros(x.shape[1] if x.size else N_FEATURES)
        if not len(y) or y.min() == y.max():
            return cls(zero, zero + 1, {}, 0.5 if not len(y) else float((y.sum() + 0.5) / (len(y) + 1)))
        rng = np.random.default_rng(seed)
        shapes = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
        parts = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) if s and k != "b" else np.zeros(s) for k, s in shapes.items()}
        model = cls(x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3, parts)
        m1, m2 = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
        step, n = 0, len(y)
        size = np.diff(bounds)
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                own = order[a : a + batch]
                ends = np.concatenate([[0], np.cumsum(size[own])])
                rows = np.arange(ends[-1]) - np.repeat(ends[:-1], size[own]) + np.repeat(bounds[own], size[own])
                grads = model._gradients(x[rows], ends, y[own])
                step += 1
                for k, g in grads.items():
                    g = g + decay * parts[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    parts[k] = parts[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            rate *= 0.96
        return model

    def _gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        z, h, t, g, a, bag, logit = self.forward(x, bounds)
        n = np.diff(bounds)
        out = (sigmoid(logit) - y) / len(y)
        d_bag = np.repeat(out[:, None] * p["c"][None, :], n, axis=0)
        d_a = (d_bag * h).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, bounds[:-1]), n))
        d_tg = d_e[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h = (d_bag * a[:, None] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - h * h)
        return {"W": z.T @ d_h, "b": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": bag.T @ out, "d": out.sum()}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = 8000) -> AttentionModel:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fifth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                x, bounds = passage_features(data, offsets)
                bags += [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(bags, pa.binary())], ["id", "y", "bag"])

    sample = training_sample(docs, labels, label, train_docs)
    got = sorted(sample.select("id", "y", "text").mapInArrow(run, "id long, y double, bag binary").collect(), key=lambda r: (r["id"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.empty((0, N_FEATURES), dtype=np.float32)
    return AttentionModel.fit(x, bounds, np.array([r["y"] for r in got]))


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_passages`` of each document, from all its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column("text")):
                x, bounds = passage_features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(model.score(x, bounds).astype(np.float64)), pa.array(np.diff(bounds))], ["id", "score", "n_passages"]
                )

    rows = slim(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, n_passages long")


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``threshold``.  No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.empty(0)]
            for _, _, data, offsets in text_chunks(batch.column(at)):
                scores.append(model.score(*passage_features(data, offsets)))
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
