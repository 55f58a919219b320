"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (128-bit line hash, number of documents that hold the line), bucketed and sorted by hash. Runs have
the same buckets, so what merges or joins them reads bucket by bucket and moves nothing between tasks. `LineRuns.add`
puts a batch's run on level 0; when a level holds `fan_in` runs they are merged into one run of the next level, so n
batches leave O(log n) runs and each hash is rewritten O(log n) times. A batch's different lines meet the runs by a
merge join; those whose total reaches the threshold go, and the batch's own run is added.

One scan hashes the lines. What crosses the network for a run is a row a line and task, so a line that most documents
hold is counted where it is read. A document loses its lines by a join on a 128-bit hash of its text, so ids may repeat
or be null and other columns pass through whatever their names.

A document is a row. A null or empty text is one empty line. A key is the line stripped of ASCII white space at both
ends with A-Z lower-cased; empty keys never count. A text whose lines all go becomes empty; a null text stays null.
Repeated rows each count as a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, documents, release, shared_dir, slices, stored, text_bytes

LOWERED = byte_table((), lower=True)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def two_hashes(value: Column, prefix: str) -> list[Column]:
    """Two independently seeded 64-bit hashes."""
    return [F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(1), value).alias(f"{prefix}2")]


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each line with a key: its text, its place there, and its key as a place in the list of different keys."""
    raw, offsets = text_bytes(texts)
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    doc = np.concatenate((np.arange(len(texts)), np.searchsorted(offsets, breaks, "right") - 1))
    by = np.lexsort((starts, doc))
    starts, doc = starts[by], doc[by]
    ends = np.append(starts[1:] - 1, offsets[-1])
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    ends[last] = offsets[doc[last] + 1]
    line = np.arange(len(doc)) - np.searchsorted(doc, doc)
    # The first and the last byte of each line that is not white space.
    solid = np.flatnonzero(~_BLANK[raw])
    first, after = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(after > first)
    s, e = solid[first[some]], solid[after[some] - 1] + 1
    bounds = np.concatenate(([0], np.cumsum(e - s)))
    chars = LOWERED[raw[np.arange(bounds[-1]) + np.repeat(s - bounds[:-1], e - s)]]
    keys = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(chars)]).dictionary_encode()
    return doc[some], line[some], keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """__t1 and __t2 of the text, __pos, __h1 and __h2 of each line with a key, and whether it is its text's first of that key."""
    for b in slices(batches, "__text"):
        doc, line, code, keys = keys_of(b.column("__text"))
        names = keys.to_pylist()
        hashes = [np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in names), np.uint64, len(names)).view(np.int64)[code] for seed in (42, 1)]
        first = np.zeros(len(code), bool)
        first[np.unique(doc * (len(names) + 1) + code, return_index=True)[1]] = True
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("__t1", "__t2", "__batch")), pa.array(line.astype(np.int32)), *map(pa.array, hashes), pa.array(first)], ["__t1", "__t2", "__batch", "__pos", "__h1", "__h2", "__first"])


def hashed_lines(docs: DataFrame, text: str = "text", batches: int = 1) -> DataFrame:
    """The lines of docs by hash; __batch deals texts out to so many batches."""
    value = F.coalesce(docs[text], F.lit(""))
    batch = F.pmod(F.xxhash64(value), F.lit(batches)).cast("int").alias("__batch")
    return docs.select(*two_hashes(value, "__t"), batch, value.alias("__text")).mapInArrow(_hashed_lines, "__t1 long, __t2 long, __batch int, __pos int, __h1 long, __h2 long, __first boolean")


class LineRuns:
    """Levelled runs below `path`, a folder that executors and driver share. A run is an external table of the session's
    catalog, which knows its buckets; `close` takes the tables out of the catalog."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []
        self.written = 0

    def _table(self, df: DataFrame) -> DataFrame:
        """df bucketed and sorted by hash, a file a bucket."""
        self.written += 1
        self.names.append(f"line_run_{uuid.uuid4().hex}")
        dealt = df.repartition(self.buckets, "__h1", "__h2")
        dealt.write.format("parquet").bucketBy(self.buckets, "__h1", "__h2").sortBy("__h1", "__h2").option("path", f"{self.path}/run-{self.written}").option("compression", "zstd").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    @staticmethod
    def counts_of(lines: DataFrame) -> DataFrame:
        """For each different key of `hashed_lines` the number of rows that hold it."""
        return lines.where("__first").groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"))

    def add(self, counts: DataFrame) -> None:
        """A batch's counts as a new run; full levels are compacted."""
        run, level = self._table(counts.select("__h1", "__h2", "__n")), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            run = self._table(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The runs as one, by merge joins. Two stored runs meet bucket by bucket, without an exchange."""
        out = runs[0]
        for r in runs[1:]:
            both = out.hint("merge").join(r.withColumnRenamed("__n", "__m"), ["__h1", "__h2"], "full_outer")
            out = both.select("__h1", "__h2", (F.coalesce("__n", F.lit(0)) + F.coalesce("__m", F.lit(0))).alias("__n"))
        return out

    def frequent(self, run: DataFrame | None, at_least: int) -> DataFrame | None:
        """The lines of a batch's run (None: all) that the runs hold often: the two merge, bucket by bucket."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        often = self._merged(runs).where(F.col("__n") >= at_least).select("__h1", "__h2")
        return often if run is None else run.select("__h1", "__h2").hint("merge").join(often, ["__h1", "__h2"], "left_semi")

    def cleaned(self, docs: DataFrame, lines: DataFrame, run: DataFrame | None, at_least: int, text: str = "text") -> DataFrame:
        """docs, whose `hashed_lines` these are, and whose run is given where the runs don't hold it, with the frequent lines taken out of `text`, and __n_lines and
        __n_dropped."""
        tagged = docs.select("*", *two_hashes(F.coalesce(docs[text], F.lit("")), "__t"))
        frequent = self.frequent(run, at_least)
        if frequent is None:
            return _without(tagged.withColumn("__drop", F.lit(None).cast("array<int>")), text)
        # As tables, the joins deal out both sides themselves, and can split what one line or one text of many copies holds.
        self.written += 1
        frequent = stored(frequent, f"{self.path}/frequent-{self.written}")
        hits = lines.join(frequent, ["__h1", "__h2"], "left_semi").groupBy("__t1", "__t2").agg(F.collect_set("__pos").alias("__drop"))
        hits = stored(hits, f"{self.path}/hits-{self.written}")
        return _without(tagged.join(hits, ["__t1", "__t2"], "left"), text)

    def admit(self, docs: DataFrame, at_least: int, text: str = "text") -> DataFrame:
        """The streaming form: the batch loses the lines that earlier batches made frequent, then adds its own run."""
        lines = stored(hashed_lines(docs, text), f"{self.path}/lines-{self.written}")
        counts = stored(self.counts_of(lines), f"{self.path}/counts-{self.written}")
        out = stored(self.cleaned(docs, lines, counts, at_least, text), f"{self.path}/batch-{self.written}")
        self.add(counts)
        return out

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _without(df: DataFrame, text: str) -> DataFrame:
    """Takes the lines numbered in __drop out of the text, in time linear in its length."""
    df = df.drop("__t1", "__t2")
    names = [c for c in df.columns if c != "__drop"]
    schema = df.select(*names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops, texts = b.column("__drop"), b.column(text)
            out, n_lines, n_dropped = [], [], []
            for t, d in zip(texts, drops, strict=True):
                s = t.as_py()
                n_lines.append((s or "").count("\n") + 1)
                gone = set(d.as_py() or ()) if d.is_valid else ()
                n_dropped.append(len(gone))
                out.append("\n".join(x for i, x in enumerate(s.split("\n")) if i not in gone) if gone else s)
            columns = [pa.array(out, texts.type) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "__n_lines", "__n_dropped"])
            release()

    return df.mapInArrow(run, f"{fields}, __n_lines long, __n_dropped long")


def deduplicated(docs: DataFrame, at_least: int = 10, batches: int = 4, fan_in: int = 2, text: str = "text") -> DataFrame:
    """docs without the lines found in at_least rows. Every batch adds its run; as a line may become frequent in the last
    batch, all lines then meet the finished runs."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    lines = stored(hashed_lines(docs, text, batches), f"{path}/lines")
    runs = LineRuns(spark, path, fan_in)
    try:
        for b in range(batches):
            runs.add(LineRuns.counts_of(lines.where(F.col("__batch") == b)))
        return runs.cleaned(docs, lines, None, at_least, text)
    finally:
        runs.close()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), f AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
