"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to
3, hashed), trained by follow-the-regularised-leader with elastic-net penalties
on a bounded sample of labelled rows, then calibrated by one temperature.
Document frequencies are counted over every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .shared import appended
from .text import chunks, codepoints

BITS = 14
DIM = 1 << BITS
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _slots(cp: np.ndarray) -> list[np.ndarray]:
    """The hashed slot of the n-gram that begins at each code point, by order."""
    c = cp.astype(np.uint64) + np.uint64(1)
    out, acc = [], np.zeros(len(c), np.uint64)
    for n in range(3):
        acc = acc[: len(c) - n] * np.uint64(0x100000001B3) + c[n:] if len(c) >= n else acc[:0]
        h = (acc ^ (acc >> np.uint64(29))) * _ODD[n]
        out.append((h >> np.uint64(64 - BITS)).astype(np.intp))
    return out


def counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, n-gram counts by slot) of each text."""
    lower = [t.lower() for t in texts]
    for begin, end in chunks(lower):
        cp, at = codepoints(lower[begin:end])
        slots = _slots(cp)
        for i in range(end - begin):
            a, b = at[i], at[i + 1]
            row = np.bincount(slots[0][a:b], minlength=DIM)
            for n in (1, 2):
                if b - a > n:
                    row += np.bincount(slots[n][a : b - n], minlength=DIM)
            yield begin + i, row


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        scores = np.empty((len(texts), len(self.classes)), np.float64)
        for i, row in counts(texts):
            at = np.flatnonzero(row)
            x = row[at] * self.idf[at]
            scores[i] = (x @ self.weights[at]) / (np.sqrt(x @ x) or 1.0) + self.bias
        return softmax(scores / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from sparse rows of (slots, values). The bias has no penalty."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))
    penal1, penal2 = np.full((DIM + 1, 1), l1), np.full((DIM + 1, 1), l2)
    penal1[DIM] = penal2[DIM] = 0

    def weight(k: np.ndarray) -> np.ndarray:
        zk, p = z[k], penal1[k]
        return np.where(np.abs(zk) <= p, 0.0, -(zk - np.sign(zk) * p) / ((beta + np.sqrt(n[k])) / alpha + penal2[k]))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            k, x = np.append(rows[i][0], DIM), np.append(rows[i][1], 1.0)
            w = weight(k)
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = n[k] + g * g
            z[k] += g - (np.sqrt(grown) - np.sqrt(n[k])) / alpha * w
            n[k] = grown
    w = weight(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many documents each slot occurs, over all of them."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIM, np.int64)
        for b in batches:
            for _, row in counts(b.iloc[:, 0].tolist()):
                df += row > 0
        k = np.flatnonzero(df)
        yield pd.DataFrame({"slot": k, "df": df[k]})

    found = (
        docs.select(text).filter(F.col(text).isNotNull())
        .mapInPandas(partial, "slot int, df long")
        .groupBy("slot").agg(F.sum("df").alias("df"))
    )
    out = np.zeros(DIM, np.int64)
    for slot, n in found.toPandas().itertuples(index=False):
        out[slot] = n
    return out


def train(docs: DataFrame, max_rows: int = 2000, text: str = "text", label: str = "lang", seed: int = 7) -> Model:
    """Fit on at most ``max_rows // labels`` rows of each label, or all it has (one at least, however many labels there are).

    Which rows is decided by a hash of the text, so it repeats. A fifth of each
    label's is held out for the temperature, so every label is trained on. Idf
    comes from all documents.
    """
    labelled = docs.select(F.col(text).alias("t"), F.col(label).alias("y")).filter("t is not null and y is not null and t <> ''")
    per_label = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    idf = np.log((1.0 + (n_docs := sum(per_label.values()))) / (1.0 + np.minimum(document_frequencies(docs, text), n_docs))) + 1.0
    classes = sorted(per_label)
    if not classes:
        return Model([], idf, np.zeros((DIM, 0)), np.zeros(0), 1.0)
    share = max(1, max_rows // len(classes))
    place = (F.xxhash64(F.lit(seed), "t") / F.lit(float(1 << 64)) + 0.5).alias("u")
    least = Window.partitionBy("y").orderBy("u")
    hashed = labelled.select("y", place).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= share)
    last = {r.y: r.u for r in hashed.groupBy("y").agg(F.max("u").alias("u")).collect()}
    cuts = F.create_map(*[F.lit(x) for c in classes for x in (c, last[c])])
    # The texts of these places only are moved; of equal places (copies) no more than the share.
    chosen = labelled.withColumn("u", place).filter(F.col("u") <= cuts[F.col("y")])
    chosen = chosen.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= share)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, v = [], []
            for _, row in counts(b["t"].tolist()):
                at = np.flatnonzero(row)
                x = row[at] * idf[at]
                k.append(at.astype(np.uint16).tobytes())
                v.append((x / np.sqrt(x @ x)).astype(np.float32).tobytes())
            yield pd.DataFrame({"u": b["u"], "y": b["y"], "k": k, "v": v})

    got = chosen.mapInPandas(featurise, "u double, y string, k binary, v binary").toPandas().sort_values(["u", "y", "k", "v"])
    rows = [(np.frombuffer(k, np.uint16).astype(np.intp), np.frombuffer(v, np.float32).astype(float)) for k, v in zip(got["k"], got["v"])]
    y = np.array([classes.index(c) for c in got["y"]], dtype=int)
    order = np.random.default_rng(seed).permutation(len(rows))
    own = [order[y[order] == c] for c in range(len(classes))]
    held, fit = (order[np.isin(order, np.concatenate(part))] for part in ([o[: len(o) // 5] for o in own], [o[len(o) // 5 :] for o in own]))
    w, b = ftrl([rows[i] for i in fit], y[fit], len(classes), seed=seed)
    scores = np.array([rows[i][1] @ w[rows[i][0]] + b for i in held]).reshape(len(held), len(classes))
    return Model(classes, idf, w, b, temperature(scores, y[held]))


def identify(docs: DataFrame, max_rows: int = 2000, model: Model | None = None) -> DataFrame:
    """``(doc_id, lang, predicted, confidence)``, one row for each input row.

    ``confidence`` is the calibrated probability of ``predicted``. Null and empty
    texts get null for both, as does everything if no row is labelled; of equal
    probabilities the first language by name wins; repeated rows repeat.
    """
    m = model or train(docs, max_rows)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        def predict(texts: list[str | None]) -> list[pa.Array]:
            has = [i for i, t in enumerate(texts) if t]
            best, sure = [None] * len(texts), [None] * len(texts)
            if has and m.classes:
                p = m.probabilities([texts[i] for i in has])
                for i, k, row in zip(has, p.argmax(axis=1).tolist(), p):
                    best[i], sure[i] = m.classes[k], float(row[k])
            return [pa.array(best, pa.string()), pa.array(sure, pa.float64())]

        return predict

    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")]
    return appended(docs, kept, [StructField("predicted", StringType()), StructField("confidence", DoubleType())], start)
