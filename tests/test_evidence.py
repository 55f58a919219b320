"""Read evidence: summaries of groups over batches, and what moves for them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqweave.functions import reads as R
from seqweave.operators import evidence as EV

CIGAR = "array<struct<op:int,len:int>>"


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_described_as_by_aggregates(spark, batch):
    """Groups that fill several batches, keys of which some parts are null, and numbers that are missing or not finite."""
    rng, odd = random.Random(batch), [None, math.nan, math.inf, -math.inf]
    rows = [(k % 11, rng.choice([None, "a", "b"]), rng.choice([None, 0.0, 1.0]), rng.choice([*odd, rng.gauss(0, 9), 2.0, 2.0]) if k % 11 else None, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, f double, x double, y double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["k"], r["t"]): r.asDict() for r in EV.described(df, ["k", "t"], ["f"], ["x", "y"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    told = df.groupBy("k", "t").agg(F.count(F.lit(1)).alias("__n"), F.count("f").alias("f_count"), F.avg("f").alias("f_mean"), *EV.summaries("x"), *EV.summaries("y")).collect()
    assert len(got) == len(told)
    for r in told:
        own = got[r["k"], r["t"]]
        assert all(own[c] == v if v is None or isinstance(v, str) else own[c] == pytest.approx(v, rel=1e-9, abs=1e-9) for c, v in r.asDict().items())


def test_no_bases_are_kept_and_nothing_is_broadcast(spark, monkeypatch):
    """With a bound on reads, pairs are staged without bases, signals or operations, and they meet by merge joins."""
    seen, write = [], EV.staged
    monkeypatch.setattr(EV, "staged", lambda df: seen.append(set(df.columns)) or write(df))
    reads = [("1", k, f"q{k}", 16 * (k % 2), 20 + k, "a", 0, 10, [(0, 10)], "ACGTACGTAC", "g", 0, list(range(40)), [0.1, 0.2, 0.3]) for k in range(5)]
    df = spark.createDataFrame(reads, f"run string, read_id long, qname string, flag int, mapq int, contig string, ref_start int, ref_end int, cigar {CIGAR}, seq string, rg string, zf int, zm array<short>, zp array<float>")
    genome = spark.createDataFrame([("a", 0, "ACGTACGTACGTACGTACGTACGTACGTACGT")], "contig string, chunk long, seq string")
    orders = spark.createDataFrame([("1", "g", "TACG" * 10)], "run string, rg string, fo string")
    candidates = spark.createDataFrame([(1, "1", "a", 4, 5, "A", 1, 2), (2, "1", "a", 20, 21, "A", 1, 2)], "k long, run string, chrom string, start0 int, end0 int, hp_base string, hp_ref_len int, hp_alt_len int")
    out = EV.read_features(candidates, df, genome, orders, candidates.columns, most=3, size=32)
    assert seen and not any({"seq", "cigar", "zm"} & c for c in seen)
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert [x for x in plan if "BroadcastHashJoin" in x and "read_id" in x] == [] and not any("percentile" in x for x in plan)
    got = {r["k"]: r for r in out.collect()}
    assert (got[1]["bam_coverage"], got[1]["bam_reads_used"], got[1]["bam_reverse_reads"], got[2]["bam_coverage"], got[2]["bam_mapq_mean"]) == (5, 3, 2, 0, None)
    whole = EV.read_features(candidates, df, genome, orders, candidates.columns, most=None, size=32)
    assert {r["k"]: (r["bam_coverage"], r["bam_forward_reads"], r["bam_mapq_mean"], r["bam_mapq_median"]) for r in whole.collect()} == {1: (5, 3, 22.0, 22.0), 2: (0, 0, None, None)}


def test_alignments_as_by_columns(spark):
    """Operations of all kinds and none, reads without bases, places before, in and behind them, references cut short."""
    rng, rows = random.Random(4), []
    for k in range(3000):
        ops = None if k % 41 == 0 else [(rng.randrange(9), rng.choice([0, 1, 1, 2, 3, 8])) for _ in range(rng.randint(0, 6))]
        n = sum(m for op, m in ops or [] if op in (0, 1, 4, 7, 8))
        seq = None if k % 37 == 1 else "".join(rng.choices("ACGTac", k=max(0, n + rng.choice([0, 0, 0, -2, 3]))))
        ref_start, start = rng.randint(0, 30), rng.randint(0, 45)
        lo, end = max(start - 10, 0), start + rng.randint(1, 5)
        rows.append((k, ops, ref_start, seq, rng.random() < 0.5, "".join(rng.choices("ACGT", k=rng.choice([end + 10 - lo, end + 10 - lo, 4, 0]))), lo, start, end))
    df = spark.createDataFrame(rows, f"k long, cigar {CIGAR}, ref_start int, seq string, back boolean, ref string, lo long, s int, e int").repartition(3).localCheckpoint()
    c = F.col
    told = df.withColumn("o", R.placed(c("cigar"), c("ref_start"))).localCheckpoint()
    told = told.select("k", R.softclip_fraction(c("cigar"), c("seq")).alias("clipped"), R.query_position(c("o"), F.length(F.coalesce("seq", F.lit(""))), c("back"), c("s"), c("e")).alias("place"), R.burdens(c("o"), c("seq"), c("ref"), c("lo").cast("int"), c("e") + 10).alias("b"))
    want = {r["k"]: (r["clipped"], r["place"], r["b"]["mismatch"], r["b"]["indel"]) for r in told.collect()}
    got = {r["k"]: tuple(r["x"]) for r in df.select("k", R.alignment_evidence(c("cigar"), c("ref_start"), c("seq"), c("back"), c("ref"), c("lo"), c("s"), c("e"), 10).alias("x")).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
