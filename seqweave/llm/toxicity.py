"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A window of the normalised text is
compressed with the ordinary dictionary and with both dictionaries one after the other; the difference of the two
lengths, in bytes, is how much toxic text helps to say it. Ordinary windows come out alike under both. The decision is
calibrated on the sample: a text's counts and rates of windows over fixed thresholds of bytes saved, weighted.

The toxic dictionary is trained on what toxic texts hold at a clearly higher rate than ordinary ones (lower bound of the
one against a multiple of the upper bound of the other). Toxic texts are mostly ordinary words: trained on them whole,
the dictionaries differ by chance more than by toxic words (README).

Learning uses a bounded sample (`Bounds`); scoring covers every row and its whole text. Null and empty texts have no
window and get the score that the weights give to none. Without rows of both labels, or with too few for zstandard to
train on, every score is the share of label 1, or 0.5 without labels. Repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_SPLIT_LOWER, documents, held_out_by, slices, split_words, table
from .labelled import logistic, sample, sigmoid

WINDOW, STRIDE = 64, 44
#: Words are set apart by so many spaces: with the shortest match of MIN_MATCH bytes, whole words match before parts.
SPACES = 2
#: Bytes saved that a window is counted at.
SAVED = (2, 3, 4, 6, 8)
LEVEL, MIN_MATCH = 2, 7
ORDINARY_BYTES, TOXIC_BYTES = 48 << 10, 2 << 10
RATE_RATIO = 4.0
#: The most that a dictionary holds before its content: eight bytes and 256 of tables.
HEADER = 8 + 256


@dataclass(frozen=True)
class Bounds:
    """Texts of either label that are learned from, and the longest of them in characters."""

    toxic: int = 2500
    ordinary: int = 5000
    chars: int = 20_000


def _params() -> zstd.ZstdCompressionParameters:
    return zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_params())
    return zstd.ZstdCompressor(dict_data=d, compression_params=_params())


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples, at most so many bytes. What zstandard puts before it (magic
    number, id and entropy tables, `HEADER` bytes at most) ends where the samples' own bytes begin. ZstdError: too few
    samples to train on."""
    samples = [s for s in samples if len(s) > 8]
    made, text = zstd.train_dictionary(size + HEADER, samples, k=16, d=6).as_bytes(), b"".join(samples)
    return made[next((at for at in range(8, HEADER) if made[at : at + 8] in text), HEADER) :][-size:]


def _distinct_words(texts: list[str]) -> list[list[bytes]]:
    words = split_words(pa.array(texts, pa.string()), ALNUM_SPLIT_LOWER)
    codes, names = words.coded()
    names = names.to_pylist()
    return [[names[c] for c in np.unique(codes[a:b]).tolist()] for a, b in zip(words.docs[:-1], words.docs[1:], strict=True)]


def telling_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float = RATE_RATIO) -> set[bytes]:
    """Words whose rate among toxic texts is clearly over `ratio` times that among ordinary ones."""
    a, b = Counter(w for t in toxic for w in t), Counter(w for t in ordinary for w in t)
    least, nt, no = max(5, len(toxic) // 50), len(toxic), len(ordinary)
    out = set()
    for w, n in a.items():
        p, q = (n + 0.5) / (nt + 1), (b[w] + 0.5) / (no + 1)
        if n >= least and p - 2 * (p * (1 - p) / nt) ** 0.5 > ratio * (q + 2 * (q * (1 - q) / no) ** 0.5):
            out.add(w)
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    share: float

    @classmethod
    def learned(cls, rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
        """counts: all labelled rows; the sample is weighted to their shares."""
        total = sum(counts.values())
        share = counts.get(1, 0) / total if total else 0.5
        y = np.array([k for _, k in rows])
        if len(set(y.tolist())) < 2:
            return cls(b"", b"", None, share)
        # Each different text once: copies would let one text's words pass for common ones.
        distinct = {k: list(dict.fromkeys(t for t, label in rows if label == k)) for k in (0, 1)}
        words = {k: _distinct_words(v) for k, v in distinct.items()}
        telling = telling_words(words[1], words[0])
        space = b" " * SPACES
        bag = lambda ws, inside: space + space.join(w for w in ws if (w in telling) == inside) + space
        try:
            model = cls(_trained([bag(w, False) for w in words[0]], ORDINARY_BYTES), _trained([bag(w, True) for w in words[1]], TOXIC_BYTES), None, share)
        except zstd.ZstdError:
            return cls(b"", b"", None, share)
        x = model.features(pa.array([t for t, _ in rows], pa.string()))
        sampled = {k: int((y == k).sum()) for k in (0, 1)}
        weight = np.where(y == 1, counts[1] / sampled[1], counts[0] / sampled[0])
        model.weights = logistic(x, y, weight * len(y) / weight.sum())
        return model

    def features(self, texts: pa.Array) -> np.ndarray:
        words = split_words(texts, ALNUM_SPLIT_LOWER)
        joined, starts, ends = words.joined(SPACES)
        data = b" " * SPACES + joined
        some = np.flatnonzero(words.counts)
        # A text is the spaces, then its words with the spaces after each.
        begin, end = starts[words.docs[some]], ends[words.docs[some + 1] - 1] + 2 * SPACES
        n = np.maximum(-(-(end - begin - (WINDOW - STRIDE)) // STRIDE), 1)
        doc = np.repeat(some, n)
        at = np.repeat(begin, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(at + WINDOW, np.repeat(end, n)) - at
        saved = np.zeros(0, np.int64)
        if len(at):
            windows = zstd.BufferWithSegments(data, np.stack([at, length], axis=1).astype("<u8").tobytes())
            a, b = (c.multi_compress_to_buffer(windows, threads=1) for c in self._compressors())
            saved = np.fromiter((len(x) - len(y) for x, y in zip(a, b, strict=True)), np.int64, len(at))
        rows = len(texts)
        counts = [np.bincount(doc[saved >= q], minlength=rows) for q in SAVED]
        most = np.zeros(rows)
        np.maximum.at(most, doc, saved)
        windows = np.maximum(np.bincount(doc, minlength=rows), 1)
        mean = np.bincount(doc, weights=saved, minlength=rows) / windows
        total = np.bincount(doc, weights=np.maximum(saved, 0), minlength=rows)
        return np.column_stack([*(np.log1p(c) for c in counts), *(np.sqrt(c / windows) for c in counts), mean, most / 10, np.log1p(total)])

    def _compressors(self):
        if not hasattr(self, "_made"):
            self._made = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return sigmoid(self.weights[0] + self.features(texts) @ self.weights[1:])


def learn(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bounds: Bounds = Bounds()) -> Model:
    return Model.learned(*sample(docs, labels, label, held_out, {1: bounds.toxic, 0: bounds.ordinary}, bounds.chars))


def scored(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row and its __score. Narrow: no shuffle."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.scores(b.column("__text")), pa.float64())], [*keep, "__score"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{fields}, __score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, table(spark, sf_dir, "labels"), "toxic", held_out_by(F.col("doc_id"), 5, 0))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out_by(F.col("doc_id"), 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
