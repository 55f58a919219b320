"""That work is spread over tasks, and what reaches the driver, on files of one row group as the given tables are."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqweave.operators import evidence as EV
from seqweave.operators import genome as G
from seqweave.operators.staging import measured, spread, staged
from seqweave.plans import sequence_queries as Q


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """30,000 rows of lineitem in one row group."""
    n, folder = 30_000, tmp_path_factory.mktemp("one_group")
    pq.write_table(pa.table({
        "l_orderkey": pa.array(range(n)), "l_partkey": pa.array([k % 700 for k in range(n)]), "l_suppkey": pa.array([k % 50 for k in range(n)]), "l_linenumber": pa.array([1 + k % 7 for k in range(n)], pa.int32()),
        "l_quantity": pa.array([float(k % 50) for k in range(n)]), "l_discount": pa.array([k % 11 / 100 for k in range(n)]), "l_returnflag": pa.array(["ANR"[k % 3] for k in range(n)]),
    }), folder / "lineitem.parquet", row_group_size=n)
    return str(folder)


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rows_of_one_row_group_are_read_by_many_tasks(spark, one_group):
    rows = Q.reads(spark, one_group)
    assert tasks(rows) > 1 and rows.count() == 30_000
    few = spark.range(1000, numPartitions=1)
    assert tasks(spread(few, "id")) == 1  # few rows stay where they are


def test_signals_are_as_described(spark):
    rows = spark.createDataFrame([(0,), (511,), (512,), (9_223_372_036_854_775_000,)], "read_id long")
    for r in rows.select("read_id", F.expr(Q._SIGNALS).alias("z")).collect():
        assert list(r["z"]) == [(i * 37 + r["read_id"]) % 512 for i in range(160)]


def test_spanning_reads_of_all_lengths(spark):
    lengths = [1, 32, 64, 65, 512, 513, 5000, 40_000, 600_000, 9_000_000]
    spans = [(k, "1", "a", start, start + n, 0) for k, (start, n) in enumerate((s, n) for s in (0, 63, 64, 1000, 32_767) for n in lengths)]
    wanted = [(k, "1", "a", at, at + n) for k, (at, n) in enumerate((a, n) for a in (0, 63, 64, 127, 1000, 1063, 33_000, 500_000) for n in (1, 2, 40, 3000))]
    reads = spark.createDataFrame(spans, "read_id long, run string, contig string, ref_start int, ref_end int, flag int")
    candidates = spark.createDataFrame(wanted, "k long, run string, chrom string, start0 int, end0 int")
    got = sorted((r["k"], r["read_id"]) for r in EV.spanning(candidates, reads, ["k"]).select("k", "read_id").collect())
    assert got == sorted((c[0], r[0]) for c in wanted for r in spans if r[3] <= c[3] and r[4] >= c[4])
    assert EV.WIDTHS[0] == 64  # short reads meet only what is near


def test_events_carry_no_bases(spark, monkeypatch):
    """What is staged for the windows of discovered alleles has neither the reads' bases nor their operations."""
    seen, write = [], G.staged
    monkeypatch.setattr(G, "staged", lambda df: seen.append(df.columns) or write(df))
    cigar = "array<struct<op:int,len:int>>"
    reads = spark.createDataFrame([(k, 0, 60, "a", 0, 8, [(0, 4), (1, 2), (0, 4)], "ACGTTTACGT") for k in range(3)], f"read_id long, flag int, mapq int, contig string, ref_start int, ref_end int, cigar {cigar}, seq string")
    genome = spark.createDataFrame([("a", 0, "ACGTACGTACGTACGTACGTACGTACGTACGT")], "contig string, chunk long, seq string")
    targets = spark.createDataFrame([("a", 0, 32)], "contig string, start long, end long")
    assert EV.discovered(reads, genome, targets, size=32).first()["bam_alt_support"] == 3
    assert seen and not any({"seq", "cigar"} & set(c) for c in seen)


def test_texts_of_one_row_group_are_cut_by_many_tasks(spark, tmp_path, monkeypatch):
    from jobs import homopolymer_targets as H

    pq.write_table(pa.table({"doc_id": range(2000), "text": ["AACGTT" * 9] * 2000, "lang": ["x"] * 2000}), tmp_path / "documents.parquet", row_group_size=2000)
    seen, made = [], H.targets_of
    monkeypatch.setattr(H, "targets_of", lambda rows, config: seen.append(tasks(rows)) or made(rows, config))
    H.update(spark, f"{tmp_path}/documents.parque[t]", f"{tmp_path}/out", H.config_of())
    assert seen[0] > 1


def test_the_job_keeps_the_same_of_rows_that_share_even_their_order(spark):
    from jobs import callset_release as J

    row = lambda called: (1, 7, 3, 0.5, 0, called, "HP", called)
    schema = "run int, locus_id long, ord long, probability double, label int, original_called boolean, stratum string, control boolean"
    both = [J.released(spark.createDataFrame([row(a), row(not a)], schema).coalesce(1), 2).first()["original_called"] for a in (True, False)]
    assert both == [False, False]


def test_call_lines_of_one_row_group_are_parsed_by_many_tasks(spark, one_group):
    from seqweave.plans import model_queries as MQ

    assert tasks(MQ._records(spark, one_group)) > 1


def test_repeated_info_keys_keep_the_last_value(spark):
    from seqweave.sources import vcf

    lines = spark.createDataFrame([("1\t5\t.\tA\tC\t.\t.\tDP=1;AO=2;DP=3\tGT:GT\t0/1:1/1", 0), ("1\t5\t.\tA\tC\t.\t.\tHS;AO=2", 1), ("1\t5\t.\tA\tC\t.\t.\t.", 2)], "value string, ord long")
    got = [(r["info"], r["format"]) for r in vcf.parsed_records(lines).orderBy("ord").collect()]
    assert got == [({"AO": "2", "DP": "3"}, {"GT": "1/1"}), ({"HS": "1", "AO": "2"}, {}), ({}, {})]


def test_windows_are_not_sent_through_the_driver(spark):
    """Places of windows grow with the reads, so they meet the reference by a shuffle however short their file is."""
    rows = spark.createDataFrame([("a", k) for k in range(40)], "contig string, at long")
    genome = spark.createDataFrame([("a", k, "ACGT" * 8) for k in range(4)], "contig string, chunk long, seq string")
    near = G.windows(rows, genome, F.col("at"), F.col("at") + 4, size=32)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line and "__chunk" in line and "SortMergeJoin" not in line] == []
    assert sorted(r["__seq"] for r in near.collect()) == sorted("ACGTACGT"[k % 4 : k % 4 + 4] for k in range(40))


def grown(df) -> list[str]:
    """Joins of the plan that are no merge joins, but for the reference's chunks and what is counted first."""
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "SortMergeJoin" not in line]


def test_candidates_are_not_sent_through_the_driver(spark):
    """Candidates grow with the reads, a row a width of bins, so they meet the reads by a shuffle however short their file is."""
    reads = spark.createDataFrame([(k, "1", "a", k, k + 30, 0) for k in range(40)], "read_id long, run string, contig string, ref_start int, ref_end int, flag int")
    candidates = staged(spark.createDataFrame([(k, "1", "a", k, k + 1) for k in range(40)], "k long, run string, chrom string, start0 int, end0 int"))
    pairs = EV.spanning(candidates, reads, ["k"])
    assert grown(pairs) == [] and pairs.count() == sum(r <= c and c + 1 <= r + 30 for c in range(40) for r in range(40))


def test_forced_keys_are_not_sent_through_the_driver(spark):
    cigar = "array<struct<op:int,len:int>>"
    reads = spark.createDataFrame([("1", k, 0, 60, "a", 0, 8, [(0, 4), (1, 2), (0, 4)], "ACGTTTACGT") for k in range(3)], f"run string, read_id long, flag int, mapq int, contig string, ref_start int, ref_end int, cigar {cigar}, seq string")
    genome = spark.createDataFrame([("a", 0, "ACGTACGTACGTACGTACGTACGTACGTACGT")], "contig string, chunk long, seq string")
    keys = spark.createDataFrame([("1", "a", 3, "G", "GTT")], "run string, chrom string, pos int, ref string, alt string")
    out = EV.forced_counts(keys, reads, genome, size=32)
    assert grown(out) == [] and (out.first()["coverage"], out.first()["alt_support"]) == (3, 3)


def test_regions_are_broadcast_only_if_counted_few(spark):
    rows = spark.range(10)
    plan = lambda most: spark.range(10).join(measured(rows, most), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(10) and "SortMergeJoin" in plan(9)


@pytest.mark.parametrize("name", ["read_topk", "spanning_reads"])
def test_queries_of_spanning_reads_broadcast_nothing(spark, one_group, name):
    pq.write_table(pa.table({"p_partkey": pa.array(range(700)), "p_size": pa.array([1 + k % 50 for k in range(700)], pa.int32())}), f"{one_group}/part.parquet")
    out = Q.QUERIES[name](spark, one_group)
    assert grown(out) == [] and out.count() > 0
