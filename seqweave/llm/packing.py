"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

Texts are tokenised once; only ones over the capacity are cut. Packing needs lengths alone, and there are at most
`capacity` of them, so the plan is made on the driver from a histogram of that many rows, whatever the corpus: a
pattern of lengths is filled greedily (the longest that fits), then its smallest piece is replaced by two unpacked
pieces that fit the gap more tightly if there are such, and the pattern is repeated while pieces last. Pieces find
their slots by their rank among those of equal length: a running count over the tokenising tasks' own counts, so no
task sees all pieces of a length.

A null or empty text is the end token alone. Repeated rows are packed one by one. Other columns play no part.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_SPLIT, SPACE_SPLIT_LOWER, documents, shared_dir, slices, split_words, stored, text_bytes

CAPACITY = 2048
#: Bytes of text tokenised at once, so many that words repeat.
TOKEN_BYTES = 2 << 20
#: Different words whose ids a worker remembers before it starts afresh, the bytes that these may take, and words encoded
#: in one call.
REMEMBERED, REMEMBERED_BYTES, CALL = 800_000, 48 << 20, 8192
#: No token spans a letter and one of these. An apostrophe starts contractions, and special tokens hold < | >.
MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;?@[]^_`{}~"))
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths with how often each is used; counts[n] pieces of length n, 1 <= n <= capacity."""
    left = [int(c) for c in counts]
    out: list[tuple[list[int], int]] = []
    stock = sum(1 << n for n in range(1, capacity + 1) if left[n])
    while stock:
        used: dict[int, int] = {}
        bits = stock

        def take(n: int) -> None:
            nonlocal bits
            used[n] = used.get(n, 0) + 1
            if used[n] == left[n]:
                bits &= ~(1 << n)

        def give(n: int) -> None:
            nonlocal bits
            used[n] -= 1
            bits |= 1 << n

        def fits(room: int) -> int:
            """The longest unpacked length of at most room; 0: none."""
            return (bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and bits & ((1 << (room + 1)) - 1) else 0

        filled, gap = [], capacity
        while n := fits(gap):
            filled.append(n)
            take(n)
            gap -= n
        if gap and len(filled) > 1:
            smallest = filled[-1]
            give(smallest)
            room, best = gap + smallest, (smallest, 0, 0)
            a = fits(room)
            while a and 2 * a > best[0]:
                take(a)
                b = min(a, fits(room - a))
                b = fits(b)
                give(a)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = fits(a - 1)
            filled.pop()
            for n in best[1:] if best[1] else (smallest,):
                filled.append(n)
                take(n)
        use = {n: filled.count(n) for n in set(filled)}
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                stock &= ~(1 << n)
        out.append((filled, times))
    return out


@dataclass
class Slots:
    """For each length the ranks at which a new pattern's pieces begin, and where those go."""

    rank: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: list[tuple[list[int], int]]) -> Slots:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for pattern, times in plan:
            at = 0
            for n in pattern:
                rows.setdefault(n, []).append((taken.get(n, 0), first, at))
                taken[n] = taken.get(n, 0) + times
                at += n
            first += times
        arrays = {n: np.array(v, np.int64) for n, v in rows.items()}
        return cls(*({n: v[:, k] for n, v in arrays.items()} for k in range(3)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            slot = np.searchsorted(self.rank[n], rank[at], "right") - 1
            sequence[at] = self.sequence[n][slot] + rank[at] - self.rank[n][slot]
            offset[at] = self.offset[n][slot]
        return sequence, offset


class Encoder:
    """Ids of words, each different one encoded once. Words are parts of a text that no token crosses."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> None:
        sizes, flat = [self.sizes], [self.flat]
        for s in range(0, len(words), CALL):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(s, CALL).cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.uint32, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32))
        self.known = pa.concat_arrays([self.known, words])
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        # The tokenizer lower-cases, but not before it looks for special tokens.
        special = b"<|" in text_bytes(texts)[0].tobytes()
        words = split_words(texts, SPACE_SPLIT if special else SPACE_SPLIT_LOWER, MARKS)
        codes, distinct = words.coded()
        if len(self.known) > REMEMBERED or self.known.nbytes + self.flat.nbytes > REMEMBERED_BYTES:
            self.forget()
        place = pc.index_in(distinct, value_set=self.known)
        missing = place.is_null()
        n = len(self.known)
        if missing.true_count:
            self._learn(distinct.filter(missing))
        at = place.to_numpy(zero_copy_only=False)
        if missing.true_count:
            at = np.where(missing.to_numpy(zero_copy_only=False), n + np.cumsum(missing.to_numpy(zero_copy_only=False)) - 1, np.nan_to_num(at))
        at = at.astype(np.int64)[codes]
        size = self.sizes[at].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.repeat(self.starts[at] - ends[:-1], size) + np.arange(ends[-1])], ends[words.docs]


def _encoder(path: str) -> Encoder:
    """The worker process's encoder, which so remembers words from task to task. It hangs on a module of its own, as what
    travels by value is made anew for each task."""
    made = sys.modules.setdefault("_seqweave_encoders", ModuleType("_seqweave_encoders")).__dict__
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def _pieces(keep: list[str], path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = _encoder(path)
        task = TaskContext.get().partitionId()
        for part, b in enumerate(slices(batches, "__text", TOKEN_BYTES)):
            ids, bounds = encoder.ids(b.column("__text"))
            row, piece, start, length, crc, tokens = [], [], [], [], [], []
            for d in range(b.num_rows):
                own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(0)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    p = own[s : s + capacity]
                    row.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(len(p))
                    crc.append(zlib.crc32(p.tobytes()))
                    if with_ids:
                        tokens.append(p)
            length = np.array(length, np.int64)
            by = np.argsort(length, kind="stable")
            ordered = length[by]
            rank = np.empty(len(length), np.int64)
            fresh = np.append(True, ordered[1:] != ordered[:-1])
            rank[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
            columns = [*(b.column(c).take(pa.array(row)) for c in keep), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc)), pa.array(np.full(len(row), task << 32 | part)), pa.array(rank)]
            names = [*keep, "__piece", "__start", "__length", "__crc", "__part", "__rank"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("__ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def packed(docs: DataFrame, keep: list[str], text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the columns `keep` of its text, __piece, __start, __length, __crc, __sequence and __offset;
    __ids too if asked for. Sorting a sequence's pieces by __offset gives it whole."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    fields = ", ".join(x for x in (fields, "__piece long, __start long, __length long, __crc long, __part long, __rank long" + ", __ids array<int>" * with_ids) if x)
    source = docs.select(*keep, docs[text].alias("__text"))
    # Written before it is counted: a part's ranks hold for its own rows only, so they are made once.
    pieces = stored(source.mapInArrow(_pieces(keep, tokenizer or tokenizer_path(), capacity, with_ids), fields), f"{path}/pieces")
    parts = pieces.groupBy("__length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.withColumn("__before", F.coalesce(before, F.lit(0))), f"{path}/parts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("__length").agg(F.sum("__n").alias("n")).collect():  # a row for each length, capacity at most
        counts[r["__length"]] = r["n"]
    slots = Slots.of(best_two_fit(counts, capacity))
    # It grows with the corpus while its files, well compressed, look small: never broadcast.
    ranked = pieces.join(parts.drop("__n").hint("merge"), ["__length", "__part"])
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("__part", "__rank")], (F.col("__rank") + F.col("__before")).alias("__rank"))
    names = [c for c in ranked.columns if c != "__rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.place(b.column("__length").to_numpy(), b.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "__sequence", "__offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema.fields)
    return ranked.mapInArrow(placed, f"{out}, __sequence long, __offset long")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("__piece").cast("int").alias("piece"), F.col("__start").alias("start"), F.col("__length").alias("length"), F.col("__crc").alias("ids_crc32"), F.col("__sequence").alias("sequence_id"), F.col("__offset").alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(documents(spark, sf_dir), ["doc_id"]))
