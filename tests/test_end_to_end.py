"""Sources and the dataset builders on small files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seqweave import cli
from seqweave.operators import metrics as M
from seqweave.plans import models, reports
from seqweave.sources import alignments, reference, tables, vcf

SEQ = "GATTACA" + "CCCC" + "GTCAGT" + "AAAAA" + "GCTGCATGCTAGCTAGGATCCATG" * 3
ORDER = "TACG" * 60


def bam(path, reads):
    text = f"@RG\tID:g\tFO:{ORDER}\n".encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", 1), struct.pack("<i", 5), b"chr1\0", struct.pack("<i", len(SEQ))]
    for name, flag, pos, cigar, seq in reads:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
        tags = b"RGZg\0" + b"ZFi" + struct.pack("<i", 0) + b"ZMBs" + struct.pack("<i", 200) + struct.pack("<200h", *([256] * 200)) + b"ZPBf" + struct.pack("<i", 3) + struct.pack("<3f", 0.1, 0.2, 0.3)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + packed + b"\xff" * len(seq) + tags
        out.append(struct.pack("<i", len(body)) + body)
    path.write_bytes(blocks(b"".join(out)))


def blocks(data, size=60_000, level=6):
    """data as a file of blocks, the last one empty."""
    out = []
    for k in [*range(0, len(data), size), len(data)]:
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(data[k : k + size]) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[k : k + size]), len(data[k : k + size])))
    return b"".join(out)


HEADER = "##fileformat=VCFv4.2\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "g.fa").write_text(f">chr1 test\n{SEQ[:40]}\n{SEQ[40:]}\n")
    (d / "t.bed").write_text("track x\nchr1\t0\t60\textra\n\nchr1\t50\t90\n")
    (d / "b.bed").write_text("chr1\t0\t95\n")
    (d / "bad.bed").write_text("chr1\t5\n")
    (d / "calls.vcf").write_text(
        HEADER
        + "chr1\t7\t.\tA\tAC\t30\tPASS\tHS;AO=5;DP=10;FAO=4;FDP=8;FUNC=a;b\tGT:AD\t0/1:5,5\n"
        + "chr1\t9\t.\tC\tCC\t20\tPASS\tHS;AO=5;DP=10;FAO=3;FDP=8\tGT\t0/1\n"
        + "chr1\t17\t.\tTA\tT\t10\tNOCALL\tHS;AO=2;DP=10;FR=.&STRINGENCY\tGT\t0/1\n"
        + "chr1\t12\t.\tG\t<DEL>,GT,C\t.\t.\tAO=1,2,3\tGT\t0/2\n"
    )
    (d / "aohc.vcf").write_text(HEADER + "chr1\t8\t.\tC\tCC\t.\t.\t.\tGT\t0/1\n")
    (d / "giab.vcf").write_text(HEADER + "chr1\t30\t.\tG\tT\t.\t.\t.\tGT\t0/1\nchr1\t40\t.\tA\tT,G\t.\t.\t.\tGT\t0/2\n")
    reads = []
    for k in range(6):
        ins = SEQ[:7] + "C" + SEQ[7:60]
        reads.append((f"i{k}", 16 * (k % 2), 0, [(0, 7), (1, 1), (0, 53)], ins))
        reads.append((f"r{k}", 0, 0, [(0, 60)], SEQ[:60]))
        reads.append((f"d{k}", 1024 * (k == 0), 0, [(0, 17), (2, 1), (0, 42)], SEQ[:17] + SEQ[18:60]))
    bam(d / "x.bam", reads)
    (d / "m.tsv").write_text("sample\trun\tbam\tvcf\ttruth_profile\nS1\tR1\tx.bam\tcalls.vcf\taohc\nS2\tR2\tx.bam\tcalls.vcf\tNA24385\n")
    return d


def test_manifest_and_intervals(spark, files):
    rows = tables.load_manifest(spark, f"{files}/m.tsv").collect()
    assert [r["truth_profile"] for r in rows] == ["AOHC", "HG002"] and rows[0]["bam"] == f"{files}/x.bam"
    assert tables.load_intervals(spark, f"{files}/t.bed").count() == 2
    with pytest.raises(ValueError):
        tables.load_intervals(spark, f"{files}/bad.bed")
    with pytest.raises(ValueError):
        tables.with_truth_profiles(spark.createDataFrame([("x",)], "truth_profile string"))


def test_bam_and_fasta(spark, files):
    got = alignments.read_bam(spark, f"{files}/x.bam", "R1").collect()
    assert len(got) == 18 and got[0]["seq"] == SEQ[:7] + "C" + SEQ[7:60] and got[0]["ref_end"] == 60 and got[0]["zf"] == 0 and len(got[0]["zm"]) == 200 and [tuple(c) for c in got[2]["cigar"]] == [(0, 17), (2, 1), (0, 42)]
    assert alignments.flow_orders(spark, f"{files}/x.bam", "R1").first()["fo"] == ORDER
    chunks = reference.read_genome(spark, f"{files}/g.fa", 16).orderBy("chunk").collect()
    assert "".join(r["seq"] for r in chunks) == SEQ


def test_fasta_headers_hold_marks(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 c.76A>C patch\nACGT\nAC\n>chr2 >x\nGG\n")
    rows = reference.read_genome(spark, f"{tmp_path}/g.fa", 4).orderBy("contig", "chunk").collect()
    assert [tuple(r) for r in rows] == [("chr1", 0, "ACGT"), ("chr1", 1, "AC"), ("chr2", 0, "GG")]


def test_records(spark, files):
    assert vcf.read_contigs(spark, f"{files}/calls.vcf") == ["chr1"]
    rows = vcf.read_records(spark, f"{files}/calls.vcf", "S", "R")
    first = rows.orderBy("ord").first()
    assert first["info"] == {"HS": "1", "AO": "5", "DP": "10", "FAO": "4", "FDP": "8"} and first["format"] == {"GT": "0/1", "AD": "5,5"} and first["filters"] == ["PASS"]
    lines = [r[0] for r in vcf.sanitized_lines(spark, f"{files}/calls.vcf", {"1": "one"}).collect()]
    assert "##contig=<ID=one>" in lines and any(x.startswith("##FORMAT=<ID=GT,") for x in lines) and any(x.startswith("one\t7\t.\tA\tAC\t30\tPASS\tHS;AO=5;DP=10;FAO=4;FDP=8\tGT") for x in lines)
    assert {(r["pos"], r["alt"]) for r in vcf.truth_keys(vcf.read_records(spark, f"{files}/giab.vcf"), None, True).collect()} == {(30, "T"), (40, "G")}


def test_file_counts(spark):
    """Headers, empty lines and short records don't count; a contig that the reference lacks can't mismatch."""
    chunks = spark.createDataFrame([("1", 0, "GATTACA")], "contig string, chunk long, seq string")
    lines = ["##x", "", "chr1\t5", *(f"{c}\t{p}\t.\t{r}\tC\t.\t.\t{i}" for c, p, r, i in [("chr1", 2, "at", "FUNC=a"), ("1", 7, "AC", "DP=1"), ("9", 1, "T", "A=1;FUNC=b;c"), ("1", "?", "A", ".")])]
    got = vcf.file_counts(spark.createDataFrame([("f", v) for v in lines], "file string, value string"), chunks, ["file"], 32).collect()
    assert [tuple(r) for r in got] == [("f", 4, 2, 1, 2)]


def test_kept_tables(spark, tmp_path):
    """A table is made again if a file or a parameter changes, if its marker is missing, or by force."""
    (tmp_path / "in.txt").write_text("a\nb\n")
    made = []

    def make():
        made.append(1)
        return spark.read.text(f"{tmp_path}/in.txt").withColumn("n", F.lit(len(made)))

    def kept(force=False, **parameters):
        out = tables.kept(spark, f"file://{tmp_path}/cache", "lines", [f"file://{tmp_path}/in.txt"], parameters, make, force)
        return sorted((r["value"], r["n"]) for r in out.collect())

    assert kept(k=1) == kept(k=1) == [("a", 1), ("b", 1)] and kept(k=2) == [("a", 2), ("b", 2)]
    assert kept(k=1, force=True) == kept(k=1) == [("a", 3), ("b", 3)]
    for marker in tmp_path.glob("cache/lines-*/*/marker"):
        marker.rename(marker.parent / "was")
    assert kept(k=1) == [("a", 4), ("b", 4)]
    (tmp_path / "in.txt").write_text("a\nb\nc\n")
    assert [v for v, _ in kept(k=1)] == ["a", "b", "c"] and len(made) == 5


def run(files, program, *more):
    cli.main([program, "--manifest", f"{files}/m.tsv", "--aohc-truth", f"{files}/aohc.vcf", "--giab-truth", f"{files}/giab.vcf", "--giab-bed", f"{files}/b.bed", "--target-bed", f"{files}/t.bed", "--fasta", f"{files}/g.fa", "--output-dir", f"{files}/{program}", *more])


def test_caller_dataset(spark, files):
    cache = f"file://{files}/cache"
    run(files, "build-caller", "--cache", cache)
    first = spark.read.parquet(f"{files}/build-caller/features.parquet").toJSON().collect()
    stages = sorted(p.name for p in files.glob("cache/*/*"))
    run(files, "build-caller", "--cache", cache)
    assert sorted(p.name for p in files.glob("cache/*/*")) == stages and len(stages) == 5
    assert sorted(spark.read.parquet(f"{files}/build-caller/features.parquet").toJSON().collect()) == sorted(first)
    counts = {r["run"]: r for r in spark.read.parquet(f"{files}/build-caller/call_file_counts.parquet").collect()}
    assert counts["R1"]["records"] == 4 and counts["R1"]["func_removed"] == 1 and counts["R1"]["unresolved_contigs"] == 0
    rows = {(r["run"], r["pos"], r["alt"]): r for r in spark.read.parquet(f"{files}/build-caller/features.parquet").collect()}
    # The two insertions of C are one allele at the run's start; the greater FAO stays.
    assert {k for k in rows if k[0] == "R1"} == {("R1", 7, "AC"), ("R1", 17, "T"), ("R1", 12, "GT")}
    r = rows["R1", 7, "AC"]
    assert (r["vcf_FAO"], r["label_name"], r["truth_source"], r["hp_base"], r["hp_ref_len"], r["hp_alt_len"]) == ("4", "TP", "AOHC_SYNTHETIC", "C", 4, 5)
    assert r["bam_coverage"] == 17 and r["bam_reads_used"] == 17 and r["flow_reads"] > 0 and r["bam_forward_reads"] == 14
    assert rows["R2", 7, "AC"]["label_name"] == "REFERENCE"
    assert tables.read_marker(spark, f"{files}/build-caller/VALIDATION_PASSED.json")["validation_passed"]


def test_hotspot_dataset(spark, files):
    run(files, "build-hotspot")
    rows = {(r["run"], r["pos"]): r for r in spark.read.parquet(f"{files}/build-hotspot/features.parquet").collect()}
    assert set(rows) == {("R1", 7), ("R1", 17), ("R2", 7), ("R2", 17)}
    r = rows["R1", 7]
    assert r["bam_forced_alt_support"] == 6 and r["bam_forced_coverage"] == 17 and r["original_called"] and r["paired_delta__vcf_FAO"] == 0 and r["vcf_raw_af"] == 0.5
    assert rows["R1", 17]["reason_stringency"] == 1 and not rows["R1", 17]["original_called"]
    assert spark.read.parquet(f"{files}/build-hotspot/truth.parquet").count() == 1 and spark.read.parquet(f"{files}/build-hotspot/baseline_fp.parquet").count() == 1


def test_rescue_dataset(spark, files):
    run(files, "build-rescue")
    rows = {(r["run"], r["pos"], r["ref"], r["alt"]): r for r in spark.read.parquet(f"{files}/build-rescue/features.parquet").collect()}
    assert set(rows) == {(run, *k) for run in ("R1", "R2") for k in ((7, "A", "AC"), (17, "TA", "T"))}
    r = rows["R1", 7, "A", "AC"]
    assert (r["bam_alt_support"], r["bam_discovery_depth"], r["bam_alt_forward_reads"], r["bam_alt_mapq_median"]) == (6, 17, 3, 60.0) and r["original_called"]
    truth = spark.read.parquet(f"{files}/build-rescue/truth.parquet").collect()
    assert [(t["run"], t["pos"], t["forced_alt_support"]) for t in truth] == [("R1", 7, 6)]


def test_samples_may_share_a_run_name(spark, files, tmp_path):
    manifest = tmp_path / "m.tsv"
    rows = (files / "m.tsv").read_text().replace("x.bam", f"{files}/x.bam").replace("calls.vcf", f"{files}/calls.vcf")
    manifest.write_text(rows.replace("\tR2\t", "\tR1\t"))
    for program in ("build-hotspot", "build-rescue"):
        if not (files / program / "features.parquet").exists():
            run(files, program)
        run(files, program, "--manifest", str(manifest), "--output-dir", f"{tmp_path}/{program}")
        apart, shared = (spark.read.parquet(f"{d}/{program}/features.parquet").drop("run") for d in (files, tmp_path))
        assert shared.count() == apart.count() > 0 and shared.select(*apart.columns).exceptAll(apart).isEmpty()


def test_truth_in_regions(spark, files):
    regions = spark.createDataFrame([("1", 35, 45)], "contig string, start long, end long")
    records = vcf.read_records(spark, f"{files}/giab.vcf")
    assert [r["pos"] for r in vcf.in_regions(records, regions).collect()] == [40]


def test_rescue_from_pileups(spark, files):
    for sample, r in (("S1", "R1"), ("S2", "R2")):
        (files / f"{sample}.{r}.vcf").write_text(HEADER + "chr1\t7\t.\tA\tAC,<*>\t.\t.\t.\tGT:AD:ADF:ADR:DP\t0/1:98,2,0:49,1,0:49,1,0:100\nchr1\t8\t.\tC\tCC\t.\t.\t.\tGT:AD:ADF:ADR:DP\t0/1:99,1:50,1:49,0:100\n")
    run(files, "build-rescue", "--pileups", f"{files}/{{sample}}.{{run}}.vcf", "--output-dir", f"{files}/piled")
    rows = {r["run"]: r for r in spark.read.parquet(f"{files}/piled/features.parquet").collect()}
    r = rows["R1"]
    assert len(rows) == 2 and (r["pos"], r["bam_alt_support"], r["bam_alt_forward_reads"], r["bam_alt_reverse_reads"], r["bam_alt_fraction"], r["hp_ref_len"], r["hp_alt_len"], r["bam_alt_mapq_mean"]) == (7, 2, 1, 1, 0.02, 4, 5, None)
    qc = {(r["run"], r["metric"]): r["value"] for r in spark.read.parquet(f"{files}/piled/qc_summary.parquet").collect()}
    assert qc["R1", "discovery_retained_candidates"] == "1" and qc["R1", "positive_blind_candidates"] == "1"


def test_trainers(spark):
    rows = [(f"s{k % 2}", f"r{k % 4}", f"l{k % 40}", int(k % 40 < 14), k % 5 == 0, float(k % 40 < 14) + (k * 37 % 11) / 9, None if k % 9 else 1.0, "x" if k % 3 else None, True, True, 5, 4) for k in range(160)]
    df = spark.createDataFrame(rows, "sample string, run string, locus_id string, label int, original_called boolean, vcf_AF double, flow_x double, vcf_TYPE string, reference_match boolean, is_homopolymer_indel boolean, hp_ref_len int, hp_alt_len int").cache()
    results, scored = models.train_ablation(df.drop("original_called"), trees=3)
    assert results.count() == 3 and scored.where("probability_M1_VCF BETWEEN 0 AND 1").count() == scored.count() > 0
    out, thresholds = models.train_addon(df, folds=2, inner_folds=2, trees=2, models=["A1_VCF_CONTEXT"])
    assert out.count() == 160 and thresholds.count() == 2 and out.where("original_called AND NOT final_called").isEmpty()


def test_rescue_experiment(spark):
    rows = [(f"s{k % 2}", f"r{k % 4}", f"l{k % 40}", int(k % 40 < 14), "AOHC_SYNTHETIC" if k % 40 < 9 else "GIAB_HG002", float(k % 40 < 14) + (k * 37 % 11) / 9) for k in range(160)]
    df = spark.createDataFrame(rows, "sample string, run string, locus_id string, label int, truth_source string, bam_alt_support double").withColumn("flow_x", F.col("bam_alt_support") + 1)
    truth = df.where("label = 1").select("sample", "run", "locus_id", "truth_source").dropDuplicates(["sample", "run", "locus_id"]).withColumn("original_called", F.col("locus_id") == "l3")
    baseline = df.where("locus_id = 'l20'").select("sample", "run", "locus_id")
    made = models.train_rescue(df.dropDuplicates(["sample", "run", "locus_id"]), truth, baseline, folds=2, bootstrap=20, trees=2, models=["R0_DISCOVERY"])
    got = {r["system"]: r for r in made["end_to_end_metrics"].collect()}
    first, own, n = got["ORIGINAL"], got["R0_DISCOVERY"], truth.count()
    assert (first["TP"], first["FP"], first["truth_total"], first["sensitivity_gain_vs_original"], first["feature_count"]) == (truth.where("original_called").count(), baseline.count(), n, 0, 0)
    assert own["TP"] - first["TP"] == own["rescued_original_fn"] - own["lost_original_tp"] and 0 <= own["sensitivity_ci95_low_locus_bootstrap"] <= own["sensitivity_ci95_high_locus_bootstrap"] <= 1 and own["candidate_pr_auc"] > 0.5
    assert own["meets_exploratory_success_gate"] == (own["sensitivity_gain_vs_original"] >= 0.1 and own["additional_fp_per_run_vs_original"] <= 2)
    for name in ("per_run_metrics", "per_sample_metrics"):
        assert {r["system"]: r["t"] for r in made[name].groupBy("system").agg(F.sum("truth_total").alias("t")).collect()} == {"ORIGINAL": n, "R0_DISCOVERY": n}
    assert made["posthoc_fp_budget_metrics"].first()["FP"] <= baseline.count() + 8 and made["truth_end_to_end_predictions"].count() == n
    with pytest.raises(ValueError):
        models.train_rescue(df, truth, baseline, positive_source="nowhere")


def test_addon_reports(spark):
    scored = spark.createDataFrame([("A", "s", "r1", f"l{k}", int(k < 4), k == 0, 0.9 - k / 10, 0.45, "AOHC", "HP" if k % 2 else "NON_HP") for k in range(8)], "system string, sample string, run string, locus_id string, label int, original_called boolean, probability double, threshold double, truth_profile string, evaluation_stratum string")
    scored = M.addon_calls(scored, F.col("threshold"))
    truth = scored.where("label = 1").select("sample", "run", "locus_id", "original_called", "evaluation_stratum").unionByName(spark.createDataFrame([("s", "r1", "l9", False, "HP")], "sample string, run string, locus_id string, original_called boolean, evaluation_stratum string"))
    baseline = spark.createDataFrame([("s", "r1", "b", "HP")], "sample string, run string, locus_id string, evaluation_stratum string")
    out = {(r["system"], r["evaluation_stratum"]): r for r in models.addon_reports(scored, truth, baseline, required=3)["addon_ablation_metrics"].collect()}
    r = out["A", "ALL"]
    assert (r["TP"], r["FN"], r["baseline_FP"], r["additional_FP"], r["rescued_original_fn"], r["meets_predefined_gate"]) == (4, 1, 1, 1, 3, True)
    assert out["ORIGINAL", "ALL"]["TP"] == 1 and out["ORIGINAL", "HP"]["truth_total"] == 3 and not out["A", "HP"]["meets_predefined_gate"]
    assert [x["system"] for x in reports.ordered_systems(spark.createDataFrame([("b",), ("a",), ("c",)], "system string"), ["a", "b"]).collect()] == ["a", "b"]


def test_train_commands(spark, tmp_path):
    rows = [("s", f"r{k % 2}", f"l{k}", int(k < 12), "AOHC_SYNTHETIC", "AOHC", "HP", k == 0, float(k < 12) + (k * 37 % 11) / 9, "x") for k in range(30)]
    names = "sample string, run string, locus_id string, label int, truth_source string, truth_profile string, evaluation_stratum string, original_called boolean, bam_alt_support double, vcf_TYPE string"
    df = spark.createDataFrame(rows, names).withColumns({"flow_x": F.col("bam_alt_support") + 1, "paired_delta__x": F.col("bam_alt_support") * 2})
    data = f"{tmp_path}/data"
    df.write.parquet(f"{data}/features.parquet")
    df.where("label = 1").select("sample", "run", "locus_id", "truth_source", "truth_profile", "evaluation_stratum", "original_called").write.parquet(f"{data}/truth.parquet")
    df.where("locus_id = 'l20'").select("sample", "run", "locus_id", "truth_profile", "evaluation_stratum").write.parquet(f"{data}/baseline_fp.parquet")
    tables.write_marker(spark, f"{data}/VALIDATION_PASSED.json", {"validation_passed": True})
    cli.main(["train-rescue", "--dataset", data, "--output-dir", f"{tmp_path}/rescue", "--folds", "2", "--trees", "1", "--bootstrap-iterations", "5", "--positive-source", "SYNTHETIC"])
    assert spark.read.parquet(f"{tmp_path}/rescue/end_to_end_metrics.parquet").count() == 4 and spark.read.parquet(f"{tmp_path}/rescue/locus_fold_assignments.parquet").count() == 30
    assert tables.read_marker(spark, f"{tmp_path}/rescue/EXPERIMENT_COMPLETE.json")["complete"] and set(tables.read_marker(spark, f"{tmp_path}/rescue/feature_sets.json")) == {"R0_DISCOVERY", "R1_BAM", "R2_BAM_FLOW"}
