"""Context-triggered piecewise hashing: fingerprints of whole texts that stay alike where the texts do.

A rolling hash of the last seven bytes ends a chunk wherever it is -1 modulo the block size 3 * 2^k; boundaries at k + 1
are among those at k. A fingerprint is `block:signature:signature of the doubled block`; a signature has one of 64
characters a chunk. The block size is the smallest that cuts the text into at most 64 chunks, so long and periodic texts
need no cap. Signatures are compared by edit distance where two fingerprints share a block size: likeness is 1 less the
distance over the longer length, the larger of two shared ones; it is 0 where they share no run of four characters
(of half the shorter one, if that is less) or no block size.

Numpy makes boundaries and chunk hashes of a slice of texts at once, and edit distances of many pairs in words of 64
bits. To give each text its neighbour by id, rows are sorted by ranges and streamed: the text of a row meets the next
row of its partition, and only first and last rows of partitions, two a partition, are joined afterwards. Of a text that is one short piece repeated, most boundaries are lost at once
as blocks grow, so its signature can be a character or two and any edit changes all of it.

Defined cases: a null text is empty; the empty text has the fingerprint `3::`, is like itself (1) and unlike all else
(0). Equal texts have equal fingerprints. Neighbours go by descending id, null ids last, equal ids by their texts'
hashes; a table of one row neighbours itself; an empty table has no row. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, slices, stored, text_bytes

WINDOW, MOST, GATE = 7, 64, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PRIME, _MIX = 0x9E3779B1, np.uint64(0xFF51AFD7ED558CCD)
#: An odd number and its inverse modulo 2^64: sums over bytes times its powers are moved to a chunk's start with it.
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _levels(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each byte the largest k whose block size ends a chunk there, -1 if none does. first: the byte's place in its text."""
    h = np.zeros(len(raw), np.uint32)
    factor = 1
    for back in range(min(WINDOW, len(raw))):
        part = raw[: len(raw) - back].astype(np.uint32) + np.uint32(1)
        part *= np.uint32(factor)
        part[first[back:] < back] = 0
        h[back:] += part
        factor = factor * _PRIME & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    up = h.astype(np.int64) + 1
    low = up & -up
    return np.where(up % 3 == 0, np.frexp(low.astype(np.float64))[1] - 1, -1).astype(np.int8)


def fingerprints_of(texts: pa.Array) -> pa.Array:
    raw, offsets = text_bytes(texts)
    n, sizes = len(texts), np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    level = _levels(raw, place)
    at = np.flatnonzero(level >= 0)
    doc = np.searchsorted(offsets, at, "right") - 1
    # Chunks of each text by level: those that end at a boundary, and what is left behind the last one.
    counts = np.zeros((n, 34), np.int64)
    np.add.at(counts, (doc, level[at].astype(np.int64)), 1)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    open_end = np.zeros((n, 34), bool)
    ends = np.full(n, -1, np.int64)
    full = sizes > 0
    ends[full] = level[offsets[1:][full] - 1]
    open_end[full] = ends[full][:, None] < np.arange(34)
    chunks = counts + open_end
    base = (chunks <= MOST).argmax(axis=1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))[: len(raw)], dtype=np.uint64)))
    back = _powers(_INVERSE, len(raw))
    signatures = []
    for more in (0, 1):
        picked = at[level[at] >= (base + more)[doc]] + 1
        stops = np.unique(np.concatenate((picked, offsets[1:][full])))
        starts = np.concatenate((np.zeros(1, np.int64), stops[:-1]))
        h = (total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64)
        h ^= h >> np.uint64(33)
        h *= _MIX
        chars = ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()
        bounds = np.searchsorted(stops, offsets, "right").tolist()
        signatures.append([chars[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return pa.array([f"{3 << k}:{a}:{b}" for k, a, b in zip(base.tolist(), *signatures, strict=True)], pa.string())


def _packed(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, signatures), np.int64, len(signatures))
    out = np.zeros((len(signatures), MOST), np.uint8)
    out[np.arange(MOST) < lengths[:, None]] = np.frombuffer(b"".join(signatures), np.uint8)
    return out, lengths


def _shared_run(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows of a and b share a run of GATE characters, or of half the shorter one if that is less."""
    least = np.clip(np.minimum(n, m) // 2, 1, GATE)
    run, found = np.zeros((len(a), MOST + 1), np.int64), np.zeros(len(a), bool)
    for j in range(int(m.max(initial=0))):
        equal = (a == b[:, j : j + 1]) & (np.arange(MOST) < n[:, None]) & (j < m)[:, None]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        found |= (run >= least[:, None]).any(axis=1)
    return found


def distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of rows of at most 64 characters: Myers's bit vectors, a pair a word."""
    pairs = np.arange(len(a))
    masks = np.zeros((len(a), 256), np.uint64)
    for i in range(MOST):
        masks[pairs, a[:, i]] |= np.where(i < n, np.uint64(1) << np.uint64(i), np.uint64(0))
    one, ones = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    pv, mv, score = np.full(len(a), ones), np.zeros(len(a), np.uint64), n.copy()
    last = np.where(n > 0, one << np.maximum(n - 1, 0).astype(np.uint64), np.uint64(0))
    for j in range(int(m.max(initial=0))):
        eq = masks[pairs, b[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        live = j < m
        score += np.where(live, ((ph & last) != 0).astype(np.int64) - ((mh & last) != 0), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(n == 0, m, score)


def likeness(one: pa.Array, other: pa.Array) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; null where either is."""
    out, firsts, seconds, rows = np.zeros(len(one)), [], [], []
    for k, (x, y) in enumerate(zip(one.to_pylist(), other.to_pylist(), strict=True)):
        if x is None or y is None:
            out[k] = np.nan
            continue
        if x == y:
            out[k] = 1.0
            continue
        (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for u, v in [(a, b), (a2, b2)] if p == q else [(a2, b)] if 2 * p == q else [(a, b2)] if p == 2 * q else []:
            firsts.append(u.encode())
            seconds.append(v.encode())
            rows.append(k)
    if rows:
        (a, n), (b, m) = _packed(firsts), _packed(seconds)
        longer = np.maximum(n, m)
        found = np.where(_shared_run(a, n, b, m), 1 - distances(a, n, b, m) / np.maximum(longer, 1), 0.0)
        np.maximum.at(out, rows, found)
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of each row and the text's __fingerprint. No shuffle."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fingerprints_of(b.column("__text"))], [*keep, "__fingerprint"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{fields}, __fingerprint string")


def compared(pairs: DataFrame, one: str, other: str, name: str = "__likeness") -> DataFrame:
    """pairs with the likeness of two columns of fingerprints, null where either is."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(likeness(b.column(one), b.column(other)), from_pandas=True)], [*b.schema.names, name])

    return pairs.mapInArrow(run, f"{fields}, `{name}` double")


def _edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its last third (rounded down) replaced by as much of the beginning of the one that follows."""
    return [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, following, strict=True)]


_FOUND = "__n long, __edited_sha256 string, __fingerprint string, __edited_fingerprint string, __near_edited double, __near_next double"


def _judged(texts: list[str], following: list[str], prints: pa.Array, next_prints: pa.Array) -> list[pa.Array]:
    changed = _edited(texts, following)
    edited = fingerprints_of(pa.array(changed, pa.large_string()))
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return [pa.array(list(map(len, texts)), pa.int64()), pa.array(shas), prints, edited, pa.array(likeness(prints, edited)), pa.array(likeness(prints, next_prints))]


def _texts(column: pa.Array) -> list[str]:
    return column.cast(pa.large_string()).fill_null("").to_pylist()


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id of each row with the fingerprints of its text and of the text edited by the next row in descending order."""
    path = shared_dir(docs.sparkSession)
    key = [F.col("__id").desc_nulls_last(), F.xxhash64("__text").desc()]
    rows = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text")).repartitionByRange(*key).sortWithinPartitions(*key)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out(ids: pa.Array, found: list[pa.Array] | None, edge: int, texts: pa.Array | None) -> pa.RecordBatch:
            n = len(ids)
            blank = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([ids, *(found or blank), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), texts if texts is not None else pa.nulls(n, pa.string())], names)

        names = ["__id", "__n", "__edited_sha256", "__fingerprint", "__edited_fingerprint", "__near_edited", "__near_next", "__part", "__edge", "__text"]
        held = None  # the last row so far: its id, text and fingerprint
        for b in slices(batches, "__text"):
            ids, texts, prints = b.column("__id"), _texts(b.column("__text")), fingerprints_of(b.column("__text"))
            if held is None:
                yield out(ids[:1], None, 1, pa.array(texts[:1]))
            else:
                ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], pa.concat_arrays([held[2], prints])
            if len(texts) > 1:
                yield out(ids[:-1], _judged(texts[:-1], texts[1:], prints[:-1], prints[1:]), 0, None)
            held = (ids[-1:], texts[-1], prints[-1:])
        if held is not None:
            yield out(held[0], None, 2, pa.array([held[1]]))

    met = stored(rows.mapInArrow(run, f"__id {kind}, {_FOUND}, __part int, __edge int, __text string"), f"{path}/neighbours")
    # Two rows a partition are left: the last of each goes on with the first of the next one, that of the last with the very first.
    parts = met.where("__edge = 1").select("__part")
    order = Window.orderBy("__part")
    after = parts.select("__part", F.coalesce(F.lead("__part").over(order), F.min("__part").over(Window.partitionBy())).alias("__after"))
    heads = met.where("__edge = 1").select(F.col("__part").alias("__after"), F.col("__text").alias("__next"))
    edges = met.where("__edge = 2").select("__id", "__part", "__text").join(after, "__part").join(heads, "__after").select("__id", "__text", "__next")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__n", "__edited_sha256", "__fingerprint", "__edited_fingerprint", "__near_edited", "__near_next"]
        for b in slices(batches, "__text"):
            texts, following = b.column("__text"), b.column("__next")
            yield pa.RecordBatch.from_arrays([b.column("__id"), *_judged(_texts(texts), _texts(following), fingerprints_of(texts), fingerprints_of(following))], names)

    return met.where("__edge = 0").drop("__part", "__edge", "__text").unionByName(edges.mapInArrow(join, f"__id {kind}, {_FOUND}"))


def op11_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"__id": "doc_id", "__n": "n_chars", "__edited_sha256": "edited_sha256", "__fingerprint": "fingerprint", "__edited_fingerprint": "edited_fingerprint", "__near_edited": "near_edited", "__near_next": "near_next"}
    return neighbours(documents(spark, sf_dir)).select(*(F.col(c).alias(n) for c, n in names.items()))
