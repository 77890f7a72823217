"""A quality classifier.

Random indexing gives each word a vector: every word has a fixed sparse random
index vector, and a word's vector is the sum of the index vectors of the words
around it, over all documents. A document pools the vectors of its words (mean,
spread, likeness of neighbours, number); a two-layer network in numpy, trained on a bounded sample of
labelled rows, scores them, and a temperature calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField

from .shared import appended
from .text import chunks, mix64, tokens

#: Words are hashed into so many slots; so many dimensions; entries of an index vector; reach of the context.
SLOTS, DIM, ENTRIES, REACH = 1 << 14, 32, 2, 2
#: Numbers that stand for a document.
POOLED = 3 * DIM + 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the entries of each slot's index vector."""
    h = mix64(np.arange(SLOTS * ENTRIES, dtype=np.uint64) + np.uint64(0x5EED)).reshape(SLOTS, ENTRIES)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, bounds = tokens(texts)
    return (h >> np.uint64(50)).astype(np.int64), bounds


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A unit vector for each slot, from the contexts in all documents; zero for a slot without any.

    Each partition adds up its own table, of fixed size; Spark adds these up by slot.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sign = _index_vectors()
        total = np.zeros(SLOTS * DIM)
        for b in batches:
            texts = b.iloc[:, 0].tolist()
            for begin, end in chunks(texts):
                w, bounds = _slots(texts[begin:end])
                doc = np.repeat(np.arange(end - begin), np.diff(bounds))
                word, other = [], []
                for off in range(1, REACH + 1):
                    near = doc[off:] == doc[:-off]
                    a, c = w[:-off][near], w[off:][near]
                    word += [a, c]
                    other += [c, a]
                y = np.concatenate(other)
                at = (np.concatenate(word)[:, None] * DIM + place[y]).ravel()
                total += np.bincount(at, weights=sign[y].ravel(), minlength=SLOTS * DIM)
        table = total.reshape(SLOTS, DIM)
        k = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame(np.column_stack([k, table[k]]), columns=["slot", *(f"v{i}" for i in range(DIM))]).astype({"slot": "int32"})

    schema = "slot int, " + ", ".join(f"v{i} double" for i in range(DIM))
    parts = docs.select(text).filter(F.col(text).isNotNull()).mapInPandas(partial, schema)
    got = parts.groupBy("slot").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toPandas().sort_values("slot")
    out = np.zeros((SLOTS, DIM), np.float32)
    if len(got):
        v = got.iloc[:, 1:].to_numpy()
        out[got["slot"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Of each text: mean and standard deviation of its word vectors, mean product of each with the next one's, logarithm of their number.

    The products show repetition, which leaves the mean as it is. Zeros without words.
    """
    out = np.zeros((len(texts), POOLED), np.float32)
    for begin, end in chunks(texts):
        w, bounds = _slots(texts[begin:end])
        n = np.diff(bounds)
        full = n > 0
        if not full.any():
            continue
        v = vectors[w]
        mean = np.add.reduceat(v, bounds[:-1][full], axis=0) / n[full, None]
        square = np.add.reduceat(v * v, bounds[:-1][full], axis=0) / n[full, None]
        after = np.zeros_like(v)
        after[:-1] = v[:-1] * v[1:]
        after[bounds[1:][full] - 1] = 0  # the next word is another text's
        near = np.add.reduceat(after, bounds[:-1][full], axis=0) / np.maximum(n[full, None] - 1, 1)
        out[begin:end][full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), near, np.log1p(n[full, None])])
    return out


@dataclass
class Network:
    """Standardised input, a tanh layer and a logistic unit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss; a fifth of the rows is held out for the temperature.

    With rows of one label only, the network says that label's smoothed share.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = np.split(order, [len(order) // 5])
    centre = x[fit].mean(axis=0) if len(fit) else np.zeros(x.shape[1])
    scale = x[fit].std(axis=0) + 1e-6 if len(fit) else np.ones(x.shape[1])
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    if len(fit) == 0 or len(np.unique(y[fit])) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(centre, scale, p[0], p[1], np.zeros(hidden), float(np.log(share / (1 - share))))
    z = (x - centre) / scale
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        mixed = rng.permutation(fit)
        for k in range(0, len(mixed), batch):
            i = mixed[k : k + batch]
            h = np.tanh(z[i] @ p[0] + p[1])
            g = (sigmoid(h @ p[2] + p[3][0]) - y[i]) / len(i)
            back = g[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for a, gr, mm, ss in zip(p, grads, m, s):
                mm += 0.1 * (gr - mm)
                ss += 0.001 * (gr * gr - ss)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    net.temperature = _temperature(net.logits(x[held]), y[held])
    return net


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        q = np.clip(sigmoid(logits / np.exp(t)), 1e-9, 1 - 1e-9)
        return -float((y * np.log(q) + (1 - y) * np.log(1 - q)).mean())

    lo, hi, g = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """The probability of good quality; 0 for a text without words."""
        x = pool(texts, self.vectors)
        return np.where(x.any(axis=1), self.network.probabilities(x), 0.0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, seed: int = 7) -> Model:
    """Word vectors from all documents; the network from at most ``max_rows`` labelled rows.

    Which labels is decided by a hash of ``doc_id``; rows with a null id or label are left out,
    and only the least of these labels for an id counts. Of documents that share an id,
    the text of least hash stands for it, so there are no more rows than labels.
    """
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_rows)  # its size is bounded, hence the broadcast
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    texts = texts.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": list(map(bytes, pool(b["text"].tolist(), vectors)))})

    got = texts.select("id", "y", "text").mapInPandas(featurise, "id long, y double, x binary").toPandas()
    got = got.sort_values(["id", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), POOLED).astype(float)
    return Model(vectors, fit_network(x, got["y"].to_numpy(dtype=float), seed=seed))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, least: float = 0.5) -> DataFrame:
    """``(doc_id, p_quality, keep)``, one row for each input row.

    ``keep`` is ``p_quality >= least``. Texts that are null, empty or without
    any word or sign have probability 0; repeated rows repeat. Without labels
    every other text has probability 0.5 and stays. An empty table gives no row.
    """
    model = train(docs, labels, max_rows)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        def judge(texts: list[str | None]) -> list[pa.Array]:
            p = model.probabilities([t or "" for t in texts])
            return [pa.array(p), pa.array(p >= least)]

        return judge

    return appended(docs, [F.col("doc_id").cast("long").alias("doc_id")], [StructField("p_quality", DoubleType()), StructField("keep", BooleanType())], start)


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, whole and with all columns, whatever their names.

    So null texts and those without a word go, rows with a null id are judged by
    their text like any other, repeated rows stay or go together, and an empty
    table stays empty.
    """
    model = train(docs, labels, max_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probabilities([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
