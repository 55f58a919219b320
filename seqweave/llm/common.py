"""What the corpus operators share: the shared folder, byte-level word splitting and batch slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.staging import new_folder

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
CHUNK_BYTES = 2 << 20

_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors and driver share; `staging.clear` deletes it."""
    return new_folder(spark, "seqweave")


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives a lost executor."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out_by(doc_id, divisor: int, remainder: int):
    """Whether crc32 of the id as text leaves the given remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(True))


def byte_table(separators: Iterable[int], lower: bool) -> np.ndarray:
    """For each byte the byte that stands for it in a word, 0 for separators."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[0x41:0x5B] += 32
    out[list(separators)] = 0
    return out


#: NUL is a word character of `[^\x20\x09-\x0D]+`; as 0 marks separators it is carried as 0xFF, which UTF-8 never holds.
def _nul_kept(t: np.ndarray) -> np.ndarray:
    if 0 not in _SPACE:
        t[0] = 0xFF
    return t


SPACE_SPLIT = _nul_kept(byte_table(_SPACE, lower=False))
SPACE_SPLIT_LOWER = _nul_kept(byte_table(_SPACE, lower=True))
#: Words of ASCII letters, digits and every non-ASCII character.
ALNUM_SPLIT_LOWER = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


@dataclass
class Words:
    """The words of some texts, one after the other, as bytes without separators."""

    chars: np.ndarray  # uint8, all words joined
    offsets: np.ndarray  # word i is chars[offsets[i]:offsets[i + 1]]
    docs: np.ndarray  # text d has the words docs[d]:docs[d + 1]
    places: np.ndarray  # where each word starts in the joined texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def coded(self) -> tuple[np.ndarray, pa.BinaryArray]:
        """Each word as its place in the list of distinct words, and that list."""
        words = pa.Array.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.chars)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def joined(self, spaces: int = 1) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by so many spaces, and where each starts and ends there."""
        n = len(self.offsets) - 1
        lengths = np.diff(self.offsets)
        starts = self.offsets[:-1] + spaces * np.arange(n)
        out = np.full(len(self.chars) + spaces * n, 0x20, np.uint8)
        out[np.arange(len(self.chars)) + spaces * np.repeat(np.arange(n), lengths)] = self.chars
        return out.tobytes(), starts, starts + lengths


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), and where each starts; one more offset ends the last."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _latin(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of ASCII or of U+00C0 to U+024F."""
    out = ((raw >= 0x41) & (raw <= 0x5A)) | ((raw >= 0x61) & (raw <= 0x7A))
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9))
    lead = lead[~((raw[lead] == 0xC3) & ((raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)))]
    out[lead] = True
    out[lead + 1] = True
    return out


def split_words(texts: pa.Array, mapped: np.ndarray, marks: np.ndarray | None = None) -> Words:
    """The texts' words. marks: a flag for each byte; if given, a word also ends between a Latin letter and a mark."""
    raw, offsets = text_bytes(texts)
    u = mapped[raw]
    keep = u != 0
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    if marks is not None:
        letter, mark = _latin(raw), marks[raw]
        start[1:] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    start[firsts] = keep[firsts]
    starts = np.flatnonzero(start)
    before = np.cumsum(keep, dtype=np.int64)
    chars = u[keep]
    if mapped[0] == 0xFF:
        chars[chars == 0xFF] = 0
    return Words(chars, np.append(before[starts] - 1, len(chars)), np.searchsorted(starts, offsets), starts)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most so many bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        release()


def release() -> None:
    """Gives memory that is free back to the system, where the C library can: a worker lives through many batches."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values within each bounds[d]:bounds[d + 1]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
