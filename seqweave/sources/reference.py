"""Reference sequences of FASTA files as chunk tables.

Spark's text source splits a file by bytes and gives each line with its split, on any file system. Lines of a task that
follow each other are one piece, taken out of the Arrow buffer as it is; a row a piece, without bases, tells by a running
sum where in its contig each piece begins; pieces are then cut into chunks where they lie, and only the chunks that two
pieces share are put together by a shuffle. Time and memory are linear in the file, whatever a contig's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.operators.genome import CHUNK
from seqweave.operators.staging import staged

#: Bases of a piece at most.
PIECE = 1 << 20
_SPACES = bytes(range(9, 14)) + b" "
_UPPER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_KEY = ["file", "block", "line", "part"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order as pieces; a piece has a name where a header opens it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values, files = batch.column("value"), batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "line"))
        offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
        raw = values.buffers()[2]
        header = pc.starts_with(values, ">").to_numpy(zero_copy_only=False)
        opens = header.copy()
        opens[0] = True
        opens[1:] |= (block[1:] != block[:-1]) | (files[1:] != files[:-1])
        first = np.flatnonzero(opens)
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(values)], strict=True):
            name = None
            if header[a]:
                name = (values[a].as_py()[1:].split(maxsplit=1) or [""])[0]
            begin, end = int(offsets[a + 1 if header[a] else a]), int(offsets[b])
            bases = raw.slice(begin, end - begin).to_pybytes().translate(_UPPER, _SPACES).decode() if end > begin else ""
            file = batch.column("file")[a].as_py()
            for k in range(0, max(len(bases), 1), PIECE):
                rows.append((file, int(block[a]), int(line[a]), k // PIECE, name if k == 0 else None, bases[k : k + PIECE]))
        yield pa.RecordBatch.from_arrays([pa.array(c) if k != 4 else pa.array(c, pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [*_KEY, "name", "bases"])


def _cut(size: int, whole: bool):
    """Pieces as chunks of `size` bases: those that lie whole in a piece, or else the parts of others, with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contigs, chunks, places, seqs = [], [], [], []
            for contig, start, bases in zip(*(batch.column(c).to_pylist() for c in ("contig", "start", "bases")), strict=True):
                end, inner = start + len(bases), (-(-start // size) * size, (start + len(bases)) // size * size)
                if whole:
                    spans = [(k, k + size) for k in range(inner[0], inner[1], size)]
                elif inner[0] <= inner[1]:
                    spans = [x for x in ((start, inner[0]), (inner[1], end)) if x[0] < x[1]]
                else:
                    spans = [(start, end)]
                if not bases and not whole:
                    spans = [(start, end)]
                for a, b in spans:
                    contigs.append(contig)
                    chunks.append(a // size)
                    places.append(a % size)
                    seqs.append(bases[a - start : b - start])
            yield pa.RecordBatch.from_arrays([pa.array(contigs, pa.string()), pa.array(chunks, pa.int64()), pa.array(places, pa.int64()), pa.array(seqs, pa.string())], ["contig", "chunk", "place", "seq"])

    return run


def read_genome(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """contig, chunk and seq of FASTA files, upper case, without white space; chunk k holds bases k * size to
    (k + 1) * size. A contig is named by the first word of its header (> at a line's start); one without bases has the
    empty chunk 0. Lines before a file's first header belong to no contig and are left out. A compressed file and a
    single very long line are read by one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    pieces = staged(lines.mapInArrow(_pieces, "file string, block long, line long, part long, name string, bases string"))
    order = Window.partitionBy("file").orderBy("block", "line", "part")
    places = pieces.select(*_KEY, "name", F.length("bases").alias("__n")).withColumn("__record", F.count("name").over(order)).where("__record > 0")
    record = Window.partitionBy("file", "__record")
    before = F.sum("__n").over(record.orderBy("block", "line", "part")) - F.col("__n")
    places = staged(places.select(*_KEY, F.max("name").over(record).alias("contig"), before.alias("start"), F.sum("__n").over(record).alias("__bases")))
    # A piece without bases matters only where its contig has none.
    placed = pieces.drop("name").join(places, _KEY).where((F.length("bases") > 0) | ((F.col("__bases") == 0) & (F.col("start") == 0))).select("contig", "start", "bases")
    schema = "contig string, chunk long, place long, seq string"
    shared = placed.mapInArrow(_cut(size, False), schema).groupBy("contig", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "seq"))).alias("__p"))
    return placed.mapInArrow(_cut(size, True), schema).select("contig", "chunk", "seq").unionByName(shared.select("contig", "chunk", F.array_join(F.transform("__p", lambda p: p["seq"]), "").alias("seq")))
