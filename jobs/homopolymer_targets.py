"""Homopolymer targets of sequences as they arrive.

    python -m jobs.homopolymer_targets --input PATTERN --output PATH [--config jobs/homopolymer_targets.json]

Homopolymer runs are where flow signals err, so evidence is gathered at them: this job keeps their intervals for a
growing set of Parquet files with sequences as text, a folder or whatever a pattern names (a single file must be
named by a pattern, as `reads.parque[t]`: a file stream takes folders). Letters A, C, G and T of either case are bases; whatever else a
text holds breaks runs, as unknown bases do. A file stream with a checkpoint takes the files that are new (availableNow:
it ends when it has taken them); each batch adds a partition to two Parquet tables:

- `targets`, by base and batch: contig (the id as text), start0 and end0 (0-based, half-open, in code points), length, and gc, the share of
  G and C among the bases of the run's piece of text;
- `counts`, by batch: runs and bases for each group, base and length.

A batch that is repeated after a failure has the same number and the same files, and replaces its own partitions
(dynamic partition overwrite), so both tables hold each file once. A rerun without new files adds nothing.

Texts are cut into pieces in one pass; a run that crosses pieces is put together from its parts, so whole runs count
whatever their length. Null texts and ids: a null text has no run, a null id keeps its runs under null. Rows that repeat
give their runs as often.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.context import gc_fraction
from seqweave.operators.staging import spread

log = logging.getLogger("homopolymer_targets")
CONFIG = Path(__file__).with_suffix(".json")
BASES = "ACGT"
TARGETS = "contig string, grp string, start0 long, end0 long, length long, gc double, base string, batch long"
COUNTS = "grp string, base string, length long, runs long, bases long, batch long"


def config_of(path: str | Path = CONFIG) -> dict:
    config = json.loads(Path(path).read_text())
    missing = sorted({"id", "sequence", "group", "min_run", "piece", "files_per_batch"} - set(config))
    if missing or min(config["min_run"], config["piece"], config["files_per_batch"]) < 1:
        raise ValueError(f"{path}: lacks {missing}" if missing else f"{path}: numbers are 1 or more")
    return config


def _runs(piece: Column, least: int) -> Column:
    """Runs of one base in a piece, as structs of base, start and length: those of at least so many bases, and the ones at
    the piece's ends. A helper over batches of pieces, as lambdas would be called for every letter."""

    @F.arrow_udf("array<struct<base:string,start:int,length:int>>")
    def found(pieces: pa.Array) -> pa.Array:
        texts = pieces.fill_null("").to_pylist()
        ends = np.cumsum([0, *map(len, texts)])
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.concatenate((np.ones(min(1, len(letters)), bool), letters[1:] != letters[:-1]))
        first[ends[:-1][ends[:-1] < len(letters)]] = True
        start = np.flatnonzero(first)
        length, of = np.diff(np.append(start, len(letters))), np.searchsorted(ends, start, "right") - 1
        edge = (start == ends[of]) | (start + length == ends[of + 1])
        kept = np.isin(letters[start], [ord(b) for b in BASES]) & (edge | (length >= least))
        start, length, of = start[kept], length[kept], of[kept]
        small = lambda x: pa.array(x.astype(np.int32))
        base = pa.array(np.array(list(BASES), object)[np.searchsorted([ord(b) for b in BASES], letters[start])], pa.string())
        values = pa.StructArray.from_arrays([base, small(start - ends[of]), small(length)], ["base", "start", "length"])
        return pa.ListArray.from_arrays(small(np.searchsorted(of, np.arange(len(texts) + 1))), values)

    return found(piece)


def targets_of(rows: DataFrame, config: dict) -> DataFrame:
    """contig, grp, base, start0, end0, length and gc of the runs of at least min_run bases."""
    size = config["piece"]
    upper = F.translate(F.col(config["sequence"]), "acgt", "ACGT")
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    pieces = numbered.select("__row", F.col(config["id"]).cast("string").alias("contig"), F.col(config["group"]).cast("string").alias("grp"), F.posexplode(F.regexp_extract_all(upper, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("__k", "__piece"))
    found = pieces.select("contig", "grp", "__row", "__k", F.length("__piece").alias("__n"), gc_fraction(F.col("__piece")).alias("gc"), F.inline(_runs(F.col("__piece"), config["min_run"])))
    # A part that touches a piece's end may go on in the next one.
    edge = ((F.col("start") == 0) & (F.col("__k") > 0)) | ((F.col("start") + F.col("length") == F.col("__n")) & (F.col("__n") == size))
    found = found.select("contig", "grp", "__row", "base", (F.col("__k").cast("long") * size + F.col("start")).alias("start0"), F.col("length").cast("long").alias("length"), "gc", edge.alias("__edge"))
    inside = found.where(~F.col("__edge") & (F.col("length") >= config["min_run"]))
    w = Window.partitionBy("__row", "base").orderBy("start0")
    opens = F.coalesce(F.lag(F.col("start0") + F.col("length")).over(w) != F.col("start0"), F.lit(True))
    parts = found.where("__edge").withColumn("__new", opens.cast("int")).withColumn("__run", F.sum("__new").over(w))
    whole = parts.groupBy("__row", "base", "__run").agg(F.first("contig").alias("contig"), F.first("grp").alias("grp"), F.min("start0").alias("start0"), F.sum("length").alias("length"), F.min_by("gc", "start0").alias("gc"))
    names = ["contig", "grp", "base", "start0", (F.col("start0") + F.col("length")).alias("end0"), "length", "gc"]
    return inside.select(*names).unionByName(whole.where(F.col("length") >= config["min_run"]).select(*names))


def update(spark: SparkSession, source: str, output: str, config: dict) -> None:
    """Takes the files of `source` that are new and adds their targets and counts to `output`."""
    save = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
    known = spark.read.parquet(source)
    columns = [config["id"], config["sequence"], config["group"]]

    def add(rows: DataFrame, batch: int) -> None:
        rows = spread(rows, config["id"], config["sequence"], few=500)  # texts may be long
        made = targets_of(rows, config).withColumn("batch", F.lit(batch)).persist(StorageLevel.DISK_ONLY)
        save(made, "targets", ("base", "batch"))
        counts = made.groupBy("grp", "base", "length", "batch").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("bases"))
        save(counts, "counts", ("batch",))
        log.info("batch %s: %s rows read, %s targets written to %s", batch, rows.count(), made.count(), output)
        made.unpersist()

    stream = spark.readStream.schema(known.select(*columns).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %s batches, all that is there has been taken", source, sum(p["numInputRows"] > 0 for p in query.recentProgress))


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """Both tables as one, told apart by `part`; counts summed over batches."""
    targets = spark.read.schema(TARGETS).parquet(f"{output}/targets").drop("batch").withColumn("part", F.lit("targets"))
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts").groupBy("grp", "base", "length").agg(F.sum("runs").alias("runs"), F.sum("bases").alias("bases"))
    return targets.unionByName(counts.withColumn("part", F.lit("counts")), allowMissingColumns=True)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    parser.add_argument("--input", required=True, help="folder or pattern of Parquet files with sequences")
    parser.add_argument("--output", required=True, help="folder of the output and the checkpoint")
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = config_of(args.config)
    spark = SparkSession.builder.appName("homopolymer_targets").getOrCreate()
    try:
        update(spark, args.input, args.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
