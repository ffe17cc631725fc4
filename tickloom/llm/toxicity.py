"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Per-coordinate learning rates and an L1 penalty leave a short list of weights, which is broadcast to score the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append_from_text, bounded_batches, broadcast_if_small, materialize

BUCKETS = 1 << 22
#: Bound of the labelled sample: rows of each label.
SAMPLE_ROWS = 2_500
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: What is cut from both ends of a word before it is hashed.
PUNCTUATION = b".,;:!?\"'()[]{}#*$%&|<>-_=+"


class WordHashes(dict):
    """64-bit hashes of stripped lower-case words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION))
        return out


def features(text: str | None, known: WordHashes) -> np.ndarray:
    """Buckets of words, pairs of neighbours, and pairs with one or two words between them; not distinct, none for no word."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int32)
    h = np.array([known[w] for w in words], np.uint64)
    parts = [h]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _MUL + np.uint64(gap)) * _MUL ^ h[gap:])
    code = np.concatenate(parts) * _MUL
    return (code >> np.uint64(64 - 22)).astype(np.int32)


@dataclass
class Ftrl:
    """FTRL-proximal: z and n for each bucket; a weight is 0 until |z| exceeds l1."""

    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.z, self.n, self.bias, self.bias_n = np.zeros(self.buckets), np.zeros(self.buckets), 0.0, 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias_n += g * g
        self.bias -= 0.1 * g / (1 + np.sqrt(self.bias_n))

    def model(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Bias, buckets with a weight (sorted) and their weights."""
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return float(self.bias), at.astype(np.int32), self.weights(at).astype(np.float32)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = 4) -> tuple[float, np.ndarray, np.ndarray]:
    """A model of (distinct buckets, label) rows, in the given order; without rows: every score 0.5."""
    out = Ftrl()
    for _ in range(epochs):
        for at, label in rows:
            out.update(at, label)
    return out.model()


def score_texts(texts: list[str | None], model: tuple[float, np.ndarray], known: WordHashes) -> np.ndarray:
    """Probability of label 1; model: bias and the weight of every bucket. Each bucket counts once in a text."""
    bias, dense = model
    out = np.full(len(texts), bias)
    for i, t in enumerate(texts):
        at = features(t, known)
        found = at[dense[at] != 0]
        if len(found):
            out[i] += dense[np.unique(found)].sum()
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """A model of about `rows` labelled documents of each label, those with the smallest hashes; all where there are fewer.

    docs (doc_id, text), labels (doc_id, label 0 or 1; other labels and null ids are no use). Only the sampled ids, whose
    number `rows` bounds, meet the texts; features are made where the texts lie and one task trains on the bounded sample.
    """
    usable = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id"])
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("label") == 1, min(1.0, rows / counts.get(1, 1))).otherwise(min(1.0, rows / counts.get(0, 1)))
    chosen = broadcast_if_small(materialize(usable.filter(draw < share), "toxic-sample"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in frames:
            yield pd.DataFrame({"one": 1, "place": [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in frame["text"]], "label": frame["label"], "at": [np.unique(features(t, known)) for t in frame["text"]]})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "label"])
        bias, at, w = train(list(zip(frame["at"], frame["label"], strict=True)))
        return pd.DataFrame({"bias": [bias], "at": [at], "w": [w]})

    sampled = bounded_batches(docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")).mapInPandas(make, "one int, place long, label int, at array<int>")
    found = sampled.groupBy("one").applyInPandas(fit, "bias double, at array<int>, w array<float>").first()
    return (found["bias"], np.array(found["at"], np.int32), np.array(found["w"], np.float32)) if found else (0.0, np.zeros(0, np.int32), np.zeros(0, np.float32))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every whole text.

    Null and wordless texts get the score of the bias alone; very long texts are scored whole. Rows are scored one by
    one: repeated rows get equal scores, an empty table gives no rows, and no column but text is an input. A caller who
    cuts at a threshold decides on which side equal scores fall."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        bias, at, w = shared.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[at] = w
        known = WordHashes()
        return lambda texts: pa.array(score_texts(texts, (bias, dense), known), pa.float64())

    return append_from_text(docs.select(F.col("doc_id").cast("long"), "text"), "score", "double", start).select("doc_id", "score")
