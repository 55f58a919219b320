"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A feature is a hashed word, pair of words, word shape or pair of shapes; its value is its rate in the text. A shape
is a word's case, whether it ends in marks, and whether it equals the word before it. Training runs FTRL-proximal
over a bounded sample; a score is the sigmoid of a sparse dot product, which for rates is the mean weight of a text's
features.

Null and empty texts have no feature and get the intercept's score. Without rows of both labels every score is the
share of label 1, or 0.5 without labels. Repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_SPLIT, documents, held_out_by, per_doc, split_words, table
from .labelled import sample, sigmoid
from .toxicity import scored

BITS = 18


@dataclass(frozen=True)
class Bounds:
    """Texts of either label that are learned from, and the longest of them in characters."""

    good: int = 3000
    poor: int = 3000
    chars: int = 20_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4
    scale: float = 20.0


def _shape(word: bytes) -> int:
    letters = bytes(c for c in word if c >= 0x80 or chr(c).isalpha())
    case = 0 if not letters else 1 if word[:1].isupper() and word[1:].islower() else 2 if letters.isupper() and len(letters) > 1 else 3
    marks = len(word) - len(word.rstrip(b"!#$%&*|<>?.,"))
    return case * 4 + min(marks, 3)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each text four hashed features, as rows; and where each text's words begin."""
    words = split_words(texts, SPACE_SPLIT)
    codes, distinct = words.coded()
    names = distinct.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    shapes = np.fromiter((_shape(w) for w in names), np.uint64, len(names))
    first = np.zeros(len(codes), bool)
    first[words.docs[:-1][words.docs[:-1] < len(codes)]] = True
    h, s = hashes[codes], shapes[codes]
    same = np.zeros(len(codes), np.uint64)
    same[1:] = codes[1:] == codes[:-1]
    same[first] = 0
    s = s * np.uint64(2) + same
    before = lambda x: np.where(first, np.uint64(0), np.concatenate((x[:1] * 0, x[:-1])))
    mix = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    kinds = [h, before(h) * np.uint64(3) + h + np.uint64(1), s + np.uint64(1 << 40), before(s) * np.uint64(64) + s + np.uint64(1 << 50)]
    with np.errstate(over="ignore"):
        return np.stack([((k ^ (k >> np.uint64(29))) * mix) >> shift for k in kinds], axis=1).astype(np.int64), words.docs


@dataclass
class Model:
    weights: np.ndarray | None
    intercept: float
    share: float
    scale: float

    @classmethod
    def learned(cls, rows: list[tuple[str, int]], counts: dict[int, int], how: Ftrl = Ftrl()) -> Model:
        total = sum(counts.values())
        share = counts.get(1, 0) / total if total else 0.5
        y = np.array([k for _, k in rows])
        if len(set(y.tolist())) < 2:
            return cls(None, 0.0, share, how.scale)
        ids, docs = features(pa.array([t for t, _ in rows], pa.string()))
        sampled = {k: int((y == k).sum()) for k in (0, 1)}
        weight = {k: counts[k] / sampled[k] for k in (0, 1)}
        mean = sum(weight[k] * sampled[k] for k in (0, 1)) / len(y)
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        examples = []
        for d in range(len(y)):
            i, c = np.unique(ids[docs[d] : docs[d + 1]], return_counts=True)
            examples.append((np.append(i, 1 << BITS), np.append(how.scale * c / max(4 * (docs[d + 1] - docs[d]), 1), 1.0)))

        def at(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            w = (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
            return np.where(np.abs(zi) <= how.l1, 0.0, w)

        order = np.random.default_rng(17)
        for _ in range(how.epochs):
            for d in order.permutation(len(y)).tolist():
                i, x = examples[d]
                w = at(i)
                g = (sigmoid(w @ x) - y[d]) * x * (weight[int(y[d])] / mean)
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w
                n[i] += g * g
        w = at(np.arange(len(z)))
        return cls(w[:-1], float(w[-1]), share, how.scale)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        ids, docs = features(texts)
        dot = per_doc(self.weights[ids].sum(axis=1), docs) / np.maximum(4 * np.diff(docs), 1)
        return sigmoid(self.intercept + self.scale * dot)


def learn(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bounds: Bounds = Bounds()) -> Model:
    return Model.learned(*sample(docs, labels, label, held_out, {1: bounds.good, 0: bounds.poor}, bounds.chars))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, table(spark, sf_dir, "labels"), "quality", held_out_by(F.col("doc_id"), 5, 0))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out_by(F.col("doc_id"), 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
