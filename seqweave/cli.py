"""Command line: build a dataset or train on one. `python -m seqweave.cli PROGRAM --help`."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.intervals import candidate_regions, merged
from seqweave.operators.metrics import inconsistent_loci
from seqweave.operators.staging import clear, staged
from seqweave.plans import builders, models
from seqweave.sources import alignments, reference, tables, vcf


def inputs_of(spark: SparkSession, args: argparse.Namespace) -> builders.Inputs:
    manifest = tables.load_manifest(spark, args.manifest, must_exist=True)
    rows = manifest.collect()  # a row a run
    if not rows:
        raise ValueError("the manifest is empty")
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    canonical = lambda df: df.withColumn("contig", tables.canonical_chrom(F.col("contig")))
    is_bam = lambda p: p.endswith(".bam")
    own = lambda df, r: df.withColumns({"sample": F.lit(r["sample"]), "run": F.lit(r["run"])})
    names = [[r["sample"], r["run"]] for r in rows]

    def stage(name: str, files: list[str], make: Callable[[], DataFrame], **parameters) -> DataFrame:
        return tables.kept(spark, args.cache, name, files, parameters, make, args.force) if args.cache else staged(make())

    no_orders = spark.createDataFrame([], "run string, rg string, fo string")
    orders = union([own(alignments.flow_orders(spark, r["bam"], r["run"]) if is_bam(r["bam"]) else no_orders, r) for r in rows])
    genome = stage("genome", [args.fasta], lambda: canonical(reference.read_genome(spark, args.fasta)))
    calls = [r["vcf"] for r in rows]
    records = stage("records", calls, lambda: union([vcf.read_records(spark, r["vcf"], r["sample"], r["run"]) for r in rows]), runs=names, paths=calls)
    reads = stage("reads", [r["bam"] for r in rows], lambda: canonical(union([own(alignments.read_bam(spark, r["bam"], r["run"]) if is_bam(r["bam"]) else spark.read.parquet(r["bam"]), r) for r in rows])), runs=names, paths=[r["bam"] for r in rows])
    flank = getattr(args, "truth_flank", None)

    def giab() -> DataFrame:
        given = vcf.read_records(spark, args.giab_truth)
        if flank is not None:
            # Labels need the truth around candidates only.
            given = vcf.in_regions(staged(given), staged(candidate_regions(vcf.truth_keys(records, genome), flank)))
        return vcf.truth_keys(given, genome, True)

    return builders.Inputs(
        manifest, records, reads, orders, stage("synthetic", [args.aohc_truth, args.fasta], lambda: vcf.truth_keys(vcf.read_records(spark, args.aohc_truth), genome)),
        stage("giab", [args.giab_truth, args.fasta, *([] if flank is None else calls)], giab, flank=flank),
        merged(tables.load_intervals(spark, args.giab_bed)), merged(tables.load_intervals(spark, args.target_bed)), genome,
    )


def call_counts(spark: SparkSession, inputs: builders.Inputs) -> DataFrame:
    """What is odd about each run's call file."""
    files = inputs.manifest.select("sample", "run", "vcf").collect()  # a row a run
    lines = [spark.read.text(r["vcf"]).select(F.lit(r["sample"]).alias("sample"), F.lit(r["run"]).alias("run"), "value") for r in files]
    return vcf.file_counts(reduce(DataFrame.unionByName, lines), inputs.genome, ["sample", "run"], inputs.size)


def _checked(spark: SparkSession, checks: DataFrame, path: str, parameters: dict, raise_first: bool) -> None:
    row = checks.first().asDict()
    failed = sorted(k for k, ok in row.items() if not ok)
    if failed and raise_first:
        raise RuntimeError(f"validation failed: {', '.join(failed)}")
    tables.write_marker(spark, path, {"validation_passed": not failed, "checks": row, "parameters": parameters})
    if failed:
        raise RuntimeError(f"validation failed: {', '.join(failed)}")


def _gated(spark: SparkSession, path: str, marker: str) -> DataFrame:
    if not tables.read_marker(spark, f"{path}/{marker}").get("validation_passed"):
        raise ValueError(f"{path} has not passed validation")
    return spark.read.parquet(f"{path}/features.parquet")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seqweave")
    programs = out.add_subparsers(dest="program", required=True)

    def program(name: str, needs: tuple[str, ...], **flags) -> None:
        p = programs.add_parser(name)
        for n in needs:
            p.add_argument(f"--{n}", required=True)
        for k, v in flags.items():
            flag = f"--{k.replace('_', '-')}"
            if v is False:
                p.add_argument(flag, action="store_true")
            elif isinstance(v, type):
                p.add_argument(flag, type=v, default=None)
            else:
                p.add_argument(flag, type=type(v), default=v)

    six = ("manifest", "aohc-truth", "giab-truth", "giab-bed", "target-bed", "fasta")
    program("build-caller", six, output_dir="output", flow_window=5, truth_flank=200, max_reads_per_candidate=int, max_candidates=0, no_flow=False, cache=str, force=False)
    program("build-rescue", six, output_dir="output/rescue", min_mapq=20, min_support=2, min_alt_fraction=0.10, min_hp_length=4, max_indel_length=50, flow_window=5, max_reads_per_candidate=30, no_flow=False, pileups=str, cache=str, force=False)
    program("build-hotspot", six, output_dir="output/hotspot", min_hp_length=4, min_mapq=20, flow_window=5, max_reads_per_candidate=50, no_flow=False, cache=str, force=False)
    program("train-caller", ("dataset",), output_dir="output/models", test_size=0.25, random_state=17, threshold=0.5, matched_recall=float, min_hp_length=2, include_context=False, trees=300)
    program("train-rescue", ("dataset",), output_dir="output/rescue_models", folds=5, threshold=0.5, min_positive_loci=5, positive_source=str, bootstrap_iterations=2000, random_state=17, trees=300)
    program("train-hotspot", ("dataset",), output_dir="output/hotspot_models", folds=5, inner_folds=4, inner_fp_budget=0, required_rescues=8, allowed_additional_fp=1, random_state=17, trees=300)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqweave").getOrCreate()
    try:
        _run(spark, args)
    finally:
        clear(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    given, out = vars(args), args.output_dir
    if args.program == "build-caller":
        inputs = inputs_of(spark, args)
        rows, counts, checks = builders.caller_dataset(inputs, args.flow_window, args.max_reads_per_candidate, args.max_candidates, not args.no_flow)
        tables.write_frame(rows, f"{out}/features")
        tables.write_frame(counts, f"{out}/qc_summary")
        tables.write_frame(call_counts(spark, inputs), f"{out}/call_file_counts")
        _checked(spark, checks, f"{out}/VALIDATION_PASSED.json", given, False)
    elif args.program in ("build-rescue", "build-hotspot"):
        inputs = inputs_of(spark, args)
        if args.program == "build-rescue":
            # Where given, candidates are read from a pileup caller's files: a path with {sample} and {run}.
            files = [vcf.read_records(spark, args.pileups.format(sample=r["sample"], run=r["run"]), r["sample"], r["run"]) for r in inputs.manifest.collect()] if args.pileups else []  # a row a run
            pileups = reduce(DataFrame.unionByName, files) if files else None
            made = builders.rescue_dataset(inputs, args.min_mapq, args.min_support, args.min_alt_fraction, args.min_hp_length, args.max_indel_length, args.flow_window, args.max_reads_per_candidate, not args.no_flow, pileups)
        else:
            made = builders.hotspot_dataset(inputs, args.min_hp_length, args.min_mapq, args.flow_window, args.max_reads_per_candidate, not args.no_flow)
        for name in ("features", "truth", "baseline_fp", "qc"):
            tables.write_frame(made[name], f"{out}/{name if name != 'qc' else 'qc_summary'}")
        tables.write_frame(call_counts(spark, inputs), f"{out}/call_file_counts")
        _checked(spark, made["checks"], f"{out}/VALIDATION_PASSED.json", given, True)
    elif args.program == "train-caller":
        results, scored = models.train_ablation(_gated(spark, args.dataset, "VALIDATION_PASSED.json"), args.test_size, args.random_state, args.threshold, args.matched_recall, args.min_hp_length, args.include_context, args.trees, out)
        tables.write_frame(models.split_of(spark.read.parquet(f"{args.dataset}/features.parquet"), args.test_size, args.random_state, args.min_hp_length), f"{out}/split_assignments")
        tables.write_marker(spark, f"{out}/feature_sets.json", models.feature_sets(scored.columns, "caller", args.include_context))
        tables.write_frame(results, f"{out}/ablation_results")
        tables.write_frame(scored, f"{out}/predictions")
        tables.write_marker(spark, f"{out}/EXPERIMENT_COMPLETE.json", {"complete": True, "parameters": given})
    elif args.program == "train-rescue":
        rows, truth, baseline = (_gated(spark, args.dataset, "VALIDATION_PASSED.json"), *(spark.read.parquet(f"{args.dataset}/{n}.parquet") for n in ("truth", "baseline_fp")))
        made = models.train_rescue(rows, truth, baseline, args.folds, args.threshold, args.random_state, args.bootstrap_iterations, args.min_positive_loci, args.trees, None, args.positive_source, out)
        for name, table in made.items():
            tables.write_frame(table, f"{out}/{name}")
        tables.write_marker(spark, f"{out}/feature_sets.json", models.feature_sets(rows.columns, "rescue"))
        tables.write_marker(spark, f"{out}/EXPERIMENT_COMPLETE.json", {"complete": True, "locus_leakage": False, "parameters": given, "truth_observations": truth.count(), "candidate_rows": rows.count(), "mixed_label_loci": inconsistent_loci(rows).count()})
    else:
        rows, truth, baseline = (_gated(spark, args.dataset, "VALIDATION_PASSED.json"), *(spark.read.parquet(f"{args.dataset}/{n}.parquet") for n in ("truth", "baseline_fp")))
        scored, thresholds = models.train_addon(rows, args.folds, args.inner_folds, args.inner_fp_budget, args.random_state, args.trees, None, out)
        scored = staged(scored)
        tables.write_frame(scored, f"{out}/oof_predictions")
        tables.write_frame(thresholds, f"{out}/nested_fold_thresholds")
        for name, table in models.addon_reports(scored, truth, baseline, args.required_rescues, args.allowed_additional_fp).items():
            tables.write_frame(table, f"{out}/{name}")
        tables.write_marker(spark, f"{out}/feature_sets.json", models.feature_sets(rows.columns, "hotspot"))
        tables.write_marker(spark, f"{out}/EXPERIMENT_COMPLETE.json", {"complete": True, "original_calls_retained": True, "unknown_rows_excluded": True, "parameters": given})


if __name__ == "__main__":
    main()
