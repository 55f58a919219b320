"""Alignment files.

BAM files are sequences of compressed blocks. Spark's text source, with the blocks' first bytes as its line separator,
splits a file by bytes on any file system and gives whole blocks; tasks inflate them and find where the first record
begins, by what a record must look like. What stands before that, and after a task's last whole record, is put together
with the neighbours' (a few kilobytes a split) and must come out as whole records, so that a wrong guess is an error and
never a wrong row. Records are decoded in columns. Written once as Parquet (`write_reads`), clustered by run, contig and
start, reads are what the operators scan; their bins prune by the Parquet statistics of ref_start.
"""

from __future__ import annotations

import contextlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.staging import staged

READ = (
    "run string, read_id long, qname string, flag int, contig string, ref_start int, ref_end int, mapq int, cigar array<struct<op:int,len:int>>, seq string, rg string, zf int, "
    "zm array<smallint>, zp array<float>"
)
NAMES = "run read_id qname flag contig ref_start ref_end mapq cigar seq rg zf zm zp".split()
#: Bases by their 4-bit code, and the sizes and formats of tag types.
BASES = "=ACMGRSVTWYHKDBN"
TAG_TYPES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: How a block begins, and the sizes of its fixed head and tail and of a record's fixed fields.
MAGIC, HEAD, TAIL, FIXED = b"\x1f\x8b\x08\x04", 18, 8, 36
#: Operations of a CIGAR that use the reference.
_ON_REFERENCE = (0, 2, 3, 7, 8)
_WANTED = {b"RG", b"ZF", b"ZM", b"ZP"}
#: Bytes of records that a task decodes at once.
RUN = 1 << 21
_EDGE = {"split": pa.int64(), "kind": pa.string(), "data": pa.binary(), "offsets": pa.list_(pa.int64()), "places": pa.list_(pa.int64())}
#: Records that must follow each other to take a place as a record's start, where there are as many.
_CHAIN = 8


def _tags(data: bytes, at: int, end: int) -> dict[bytes, object]:
    """The tags in use, of those in data[at:end]."""
    out = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            value, at = (data[at:stop].decode() if name in _WANTED else None), stop + 1
        elif kind == "B":
            item, n = TAG_TYPES[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            value = np.frombuffer(data, np.dtype(item).newbyteorder("<"), n, at + 5) if name in _WANTED else None
            at += 5 + n * struct.calcsize(item)
        else:
            item = TAG_TYPES[kind]
            value = struct.unpack_from(f"<{item}", data, at)[0] if name in _WANTED else None
            at += struct.calcsize(item)
        if name in _WANTED:
            out[name] = value
    return out


def _inflated(block: bytes) -> bytes:
    """The content of a whole block without its first four bytes."""
    extra = struct.unpack_from("<H", block, 6)[0]
    return zlib.decompress(block[8 + extra : len(block) - TAIL], -15)


def _whole_blocks(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks from what stands between block starts: where data hold the same four bytes, the parts are joined again. Where
    the block over a split's end holds such bytes (one in 200,000 does), there is an error; another split size helps."""
    held = None
    for part in parts:
        held = part if held is None else held + MAGIC + part
        size = None
        if len(held) >= HEAD - 4:
            extra, at = struct.unpack_from("<H", held, 6)[0], 8
            while at + 4 <= min(8 + extra, len(held)):
                n = struct.unpack_from("<H", held, at + 2)[0]
                if held[at : at + 2] == b"BC" and n == 2:
                    size = struct.unpack_from("<H", held, at + 4)[0] + 1 - 4
                at += 4 + n
        if size is None or len(held) > size:
            raise ValueError("no block of a BAM file")
        if len(held) == size:
            yield held
            held = None
    if held is not None:
        raise ValueError("a block of a BAM file is cut off, or holds a block's first bytes at a split's end: try another spark.sql.files.maxPartitionBytes")


def _record_size(data: bytes, at: int, contigs: int) -> int:
    """The size of the record at a place, -1 where none can be, 0 where the data end before it can be told."""
    if at + FIXED > len(data):
        return 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    least = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    if not (n_name > 0 and n_seq >= 0 and size >= least and size < 1 << 29 and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1):
        return -1
    name = data[at + FIXED : at + FIXED + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return -1
    return size + 4


def _first_record(data: bytes, contigs: int) -> int | None:
    """Where a chain of records begins, if one does."""
    for start in range(len(data)):
        at, n = start, 0
        while n < _CHAIN and (size := _record_size(data, at, contigs)) > 0:
            at, n = at + size, n + 1
            if at >= len(data):
                break
        if n and (n == _CHAIN or at >= len(data) or size == 0):
            return start
    return None


def _starts(data: bytes, at: int) -> tuple[list[int], int]:
    """Where whole records start from a place on, and where the last one ends."""
    out, n = [], len(data)
    while at + 4 <= n:
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        if end > n:
            break
        out.append(at)
        at = end
    return out, at


def _texts(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, empty_is_null: bool = False) -> pa.Array:
    """Runs of bytes as an array of texts."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    place = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[place])))
    return pc.if_else(pa.array(lengths > 0), out, pa.scalar(None, pa.string())) if empty_is_null else out


def _decoded(data: bytes, starts: list[int], ids: np.ndarray, contigs: list[str], run: str, regions: list[tuple[int, int, int]] | None) -> pa.RecordBatch:
    """Records as columns of READ; with regions (contig's number, start, end), those that overlap one."""
    raw, s = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    number = lambda at, kind: np.ascontiguousarray(raw[(s + at)[:, None] + np.arange(np.dtype(kind).itemsize)]).view(kind).ravel()
    ref, pos, n_cigar = number(4, "<i4"), number(8, "<i4"), number(16, "<u2").astype(np.int64)
    n_name = raw[s + 12].astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(n_cigar)))
    words = (np.repeat(s + FIXED + n_name - 4 * bounds[:-1], n_cigar) + 4 * np.arange(bounds[-1]))[:, None] + np.arange(4)
    words = np.ascontiguousarray(raw[words]).view("<u4").ravel()
    spans = np.concatenate(([0], np.cumsum(np.where(np.isin(words & 15, _ON_REFERENCE), words >> 4, 0), dtype=np.int64)))
    end = pos + (spans[bounds[1:]] - spans[bounds[:-1]])
    if regions is not None:
        keep = np.zeros(len(s), bool)
        for contig, a, b in regions:
            keep |= (ref == contig) & (pos < b) & (np.maximum(end, pos + 1) > a)
        kept = np.flatnonzero(keep)
        if len(kept) < len(s):
            return _decoded(data, s[kept].tolist(), ids[kept], contigs, run, None)
    n_seq = number(20, "<i4").astype(np.int64)
    at_seq = s + FIXED + n_name + 4 * n_cigar
    packed = np.concatenate(([0], np.cumsum(2 * ((n_seq + 1) // 2))))
    two = raw[np.repeat(at_seq - packed[:-1] // 2, (n_seq + 1) // 2) + np.arange(packed[-1] // 2)]
    letters = np.frombuffer(BASES.encode(), np.uint8)[np.stack((two >> 4, two & 15), axis=1).ravel()] if len(two) else np.zeros(0, np.uint8)
    tags = [_tags(data, a, b) for a, b in zip((at_seq + (n_seq + 1) // 2 + n_seq).tolist(), (s + 4 + number(0, "<i4")).tolist(), strict=True)]
    cigar = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array((words & 15).astype(np.int32)), pa.array((words >> 4).astype(np.int32))], ["op", "len"]))
    names = pa.array([*contigs, None], pa.string())
    columns = [
        pa.array([run] * len(s), pa.string()), pa.array(ids), _texts(raw, s + FIXED, n_name - 1), pa.array(number(18, "<u2").astype(np.int32)), names.take(pa.array(np.where(ref < 0, len(contigs), ref))), pa.array(pos), pa.array(end.astype(np.int32)), pa.array(raw[s + 13].astype(np.int32)),
        cigar, _texts(letters, packed[:-1], n_seq, True), pa.array([t.get(b"RG") for t in tags], pa.string()), pa.array([t.get(b"ZF") for t in tags], pa.int32()), pa.array([t.get(b"ZM") for t in tags], pa.list_(pa.int16())), pa.array([t.get(b"ZP") for t in tags], pa.list_(pa.float32())),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


class _Window:
    """Inflated bytes of neighbouring blocks, with the virtual offset and the place of each block's content."""

    def __init__(self):
        self.data, self.offsets, self.places = b"", [], []

    def add(self, data: bytes, offsets: list[int], places: list[int]) -> None:
        self.offsets += offsets
        self.places += [p + len(self.data) for p in places]
        self.data += data

    def ids(self, starts: list[int]) -> np.ndarray:
        """The virtual offsets of places."""
        block = np.searchsorted(self.places, starts, "right") - 1
        return np.asarray(self.offsets, np.int64)[block] + np.asarray(starts, np.int64) - np.asarray(self.places, np.int64)[block]

    def drop(self, end: int) -> None:
        """Forgets what stands before a place."""
        if end >= len(self.data):
            self.data, self.offsets, self.places = b"", [], []
        elif end:
            k = int(np.searchsorted(self.places, end, "right")) - 1
            self.offsets = [self.offsets[k] + end - self.places[k], *self.offsets[k + 1 :]]
            self.data, self.places = self.data[end:], [0, *(p - end for p in self.places[k + 1 :])]


def _events(parts: Iterator[bytes], at: int, skip: int | None, contigs: int) -> Iterator[tuple[str, _Window, list[int], int]]:
    """What a split holds, in order, as kind, window, starts and end: `head`, the bytes before its first record, once, if
    the first record is found (else all is `middle`); `records`; and `tail`, what is left. at: where the split's first
    block stands in the file. skip: the header's size in the first split."""
    w, begun = _Window(), False
    for block in _whole_blocks(parts):
        content = _inflated(block)
        if content:
            w.add(content, [at << 16], [0])
        at += len(block) + len(MAGIC)
        if len(w.data) >= (RUN if begun else skip if skip is not None else 1 << 18):
            begun = yield from _taken(w, begun, skip, contigs)
    if w.data and not begun:
        begun = yield from _taken(w, begun, skip, contigs)
    elif w.data:
        yield from _taken(w, True, skip, contigs)
    if w.data:
        yield "tail" if begun else "middle", w, [], len(w.data)


def _taken(w: _Window, begun: bool, skip: int | None, contigs: int):
    if not begun:
        start = skip if skip is not None else _first_record(w.data, contigs)
        if start is None or start > len(w.data):
            return False
        if skip is None:
            yield "head", w, [], start
        w.drop(start)
    starts, end = _starts(w.data, 0)
    if starts:
        yield "records", w, starts, end
        w.drop(end)
    return True


class Header:
    """The text and contigs of a BAM file, and how many of its first inflated bytes hold them."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAM\1":
            raise ValueError("no BAM file")
        n = struct.unpack_from("<i", data, 4)[0]
        self.text = data[8 : 8 + n].decode().rstrip("\0")
        at, self.contigs = 12 + n, []
        for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
            size = struct.unpack_from("<i", data, at)[0]
            self.contigs.append(data[at + 4 : at + 3 + size].decode())
            struct.unpack_from("<i", data, at + 4 + size)
            at += 8 + size
        self.size = at


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the block starts of a file, in the file's order: part, split (the first byte of its split)."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_block_start").alias("split"))


def read_header(spark: SparkSession, path: str) -> Header:
    """Of one file; only its first blocks are read."""
    n = 4
    while True:
        parts = [bytes(r["part"]) for r in _blocks(spark, path).where("split = 0").take(n)]
        contents = []
        with contextlib.suppress(ValueError):  # the last part may be a block's beginning only
            for block in _whole_blocks(iter(parts[1 : n - 1 if len(parts) == n else n])):
                contents.append(_inflated(block))
        try:
            return Header(b"".join(contents))
        except (struct.error, ValueError):
            if len(parts) < n:
                raise
            n *= 4


def read_bam(spark: SparkSession, path: str, run: str = "", regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Records of BAM files (several by commas), a task for each split of a file. read_id is a record's virtual offset:
    its block's place in the file times 65,536 and its place in the block. regions: contig, start and end, 0-based and
    half-open; records that overlap none of them are left out before their bases and tags are decoded."""
    frames = [_read(spark, p, run, regions) for p in path.split(",")]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _read(spark: SparkSession, path: str, run: str, regions: list[tuple[str, int, int]] | None) -> DataFrame:
    header, blocks = read_header(spark, path), _blocks(spark, path)
    # One row a split: how many bytes of the file stand before its first block. The first split has one part more, what
    # stands before the file's first block: nothing.
    before, total = {}, -len(MAGIC)
    for split, n in sorted(map(tuple, blocks.groupBy("split").agg(F.sum(F.length("part") + len(MAGIC))).collect())):
        before[split], total = max(total, 0), total + n
    contigs, skip = header.contigs, header.size
    wanted = None if regions is None else [(contigs.index(c), a, b) for c, a, b in regions if c in contigs]

    def found(w: _Window, starts: list[int]) -> pa.RecordBatch:
        out = _decoded(w.data, starts, w.ids(starts), contigs, run, wanted)
        return pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(out.num_rows, t) for t in _EDGE.values())], [*NAMES, *_EDGE])

    def edge(split: int, kind: str, w: _Window, end: int) -> pa.RecordBatch:
        k = int(np.searchsorted(w.places, end))
        values = [[split], [kind], [w.data[:end]], [w.offsets[:k]], [w.places[:k]]]
        blank = _decoded(b"", [], np.zeros(0, np.int64), contigs, run, None).schema
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in blank), *(pa.array(v, t) for v, t in zip(values, _EDGE.values(), strict=True))], [*NAMES, *_EDGE])

    def split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((part.as_buffer().to_pybytes(), split) for b in batches for part, split in zip(b.column(0), b.column(1).to_pylist(), strict=True))
        first = next(rows, None)
        if first is None:
            return
        # Small splits of one task follow each other in the file: they are as one.
        split = first[1]
        parts = (part for part, _ in (rows if split == 0 else itertools.chain([first], rows)))
        for kind, w, starts, end in _events(parts, before[split], skip if split == 0 else None, len(contigs)):
            yield found(w, starts) if kind == "records" else edge(split, kind, w, end)

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {"head": 0, "middle": 1, "tail": 2}
        w, wrong = _Window(), ValueError(f"{path}: records don't follow each other, or the last one is cut off")
        for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["split"], rank[r["kind"]])):
            w.add(r["data"], r["offsets"], r["places"])
            if r["kind"] == "head" and w.data:
                starts, end = _starts(w.data, 0)
                if end != len(w.data) or any(_record_size(w.data, s, len(contigs)) <= 0 for s in starts):
                    raise wrong
                yield _decoded(w.data, starts, w.ids(starts), contigs, run, wanted)
                w = _Window()
        if w.data:
            raise wrong

    met = staged(blocks.mapInArrow(split_records, f"{READ}, split long, kind string, data binary, offsets array<long>, places array<long>"))
    # Two rows a split at most, of a few kilobytes.
    edges = met.where("kind IS NOT NULL").select(*_EDGE).coalesce(1).mapInArrow(glued, READ)
    return met.where("kind IS NULL").select(*NAMES).unionByName(edges)


def flow_orders(spark: SparkSession, path: str, run: str = "") -> DataFrame:
    """run, rg and fo of the header's read groups that have both."""
    rows = []
    for line in read_header(spark, path).text.split("\n"):
        if line.startswith("@RG"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            if "ID" in tags and "FO" in tags:
                rows.append((run, tags["ID"], tags["FO"]))
    return spark.createDataFrame(rows, "run string, rg string, fo string")


def write_reads(reads: DataFrame, path: str) -> None:
    """Parquet clustered so that a region touches few row groups."""
    reads.repartitionByRange("run", "contig", "ref_start").sortWithinPartitions("run", "contig", "ref_start").write.mode("overwrite").parquet(path)
