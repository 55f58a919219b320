"""Call files: headers, sanitised records, and one row an alternative allele with its annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions import alleles as A
from seqweave.operators.calls import best_calls
from seqweave.operators.genome import normalized
from seqweave.operators.intervals import joined

#: Annotation fields that hotspot calls carry besides the common ones.
HOTSPOT_FIELDS = ("DP", "RO", "SAF", "SAR", "SRF", "SRR", "GQ")
COUNT_FIELDS = ("AD", "ADF", "ADR")


def read_contigs(spark: SparkSession, path: str) -> list[str]:
    """Contig names of the header, in order."""
    lines = spark.read.text(path).where(F.col("value").startswith("##contig=<ID="))
    names = lines.select(F.regexp_extract("value", r"^##contig=<ID=([^,>]+)", 1).alias("n"), F.monotonically_increasing_id().alias("k"))
    return [r["n"] for r in names.where("n <> ''").orderBy("k").collect()]


def read_records(spark: SparkSession, path: str, sample: str = "", run: str = "") -> DataFrame:
    """sample, run, ord, contig, pos, ref, alts, qual, filters, info and format of the first sample. gz files are read as
    they are. INFO ends at its first FUNC= field, whose value may hold semicolons; a record of fewer than eight fields
    is an error."""
    return parsed_records(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()), sample, run)


def parsed_records(lines: DataFrame, sample: str = "", run: str = "") -> DataFrame:
    """Records of lines (value, ord); header lines and empty ones go."""
    lines = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    fields = lines.select("ord", "value", F.split("value", "\t").alias("f"))
    short = fields.where(F.size("f") < 8).limit(1).collect()
    if short:
        raise ValueError(f"malformed record: {short[0]['value'][:120]!r}")
    at = lambda k: F.get("f", F.lit(k))
    known = lambda c: F.when(c != ".", c)
    info = A.sanitized_info(at(7))
    pairs = F.transform(F.filter(F.split(info, ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x))).otherwise(F.lit("1")).alias("v")))
    # Keys that repeat keep the last value; where none does, which is the rule, the map is made at once.
    folded = lambda p: F.aggregate(p, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    entries = lambda p: F.when(F.size(F.array_distinct(F.transform(p, lambda x: x["k"]))) == F.size(p), F.map_from_entries(p)).otherwise(folded(p))
    as_map = lambda p: F.get(F.transform(F.array(p), entries), F.lit(0))
    keys, values = F.split(F.coalesce(at(8), F.lit("")), ":"), F.split(F.coalesce(at(9), F.lit("")), ":")
    form = F.transform(F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda k: (F.get(keys, k) != "") & F.get(values, k).isNotNull()), lambda k: F.struct(F.get(keys, k).alias("k"), F.get(values, k).alias("v")))
    filters = F.when(known(at(6)).isNull(), F.array().cast("array<string>")).otherwise(F.split(at(6), ";"))
    return fields.select(
        F.lit(sample).alias("sample"), F.lit(run).alias("run"), "ord", at(0).alias("contig"), at(1).cast("int").alias("pos"), at(3).alias("ref"),
        F.when(known(at(4)).isNull(), F.array().cast("array<string>")).otherwise(F.split(at(4), ",")).alias("alts"), known(at(5)).try_cast("double").alias("qual"),
        filters.alias("filters"), as_map(pairs).alias("info"), as_map(form).alias("format"),
    )


def sanitized_lines(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """The file's lines with contigs renamed in header and records and FUNC cut; names: canonical to wanted name.
    A GT line is added before #CHROM where the header has none."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    wanted = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast("map<string,string>")
    renamed = lambda c: F.coalesce(F.get(F.array(F.element_at(wanted, A.canonical_chrom(c))), F.lit(0)), c)
    value = F.col("value")
    header_id = F.regexp_extract(value, r"^##contig=<ID=([^,>]+)", 1)
    header = F.concat(F.lit("##contig=<ID="), renamed(header_id), F.substring(value, F.length(header_id) + 14, F.length(value)))
    f = F.split(value, "\t")
    record = F.concat_ws("\t", renamed(F.get(f, F.lit(0))), F.array_join(F.slice(f, 2, 6), "\t"), A.sanitized_info(F.get(f, F.lit(7))), F.when(F.size(f) > 8, F.array_join(F.slice(f, F.lit(9), F.size(f)), "\t")))
    short = F.raise_error(F.concat(F.lit("a record of fewer than eight columns: "), F.substring(value, 1, 80)))
    record = F.when(F.size(f) < 8, short.cast("string")).otherwise(record)
    has_gt = not lines.where(value.startswith("##FORMAT=<ID=GT,")).isEmpty()
    gt = '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'
    out = F.when(value.startswith("##contig=<ID="), F.array(header)).when(value.startswith("#CHROM") & F.lit(not has_gt), F.array(F.lit(gt), value)).when(value.startswith("#"), F.array(value)).otherwise(F.array(record))
    return lines.select("ord", F.posexplode(out).alias("k", "value")).orderBy("ord", "k").select("value")


def file_counts(lines: DataFrame, genome: DataFrame, by: list[str], size: int | None = None) -> DataFrame:
    """by, records, func_removed, unresolved_contigs and reference_mismatches: what sanitising and moving left meet in the
    lines (by, value) of call files. A record mismatches if its contig is known and does not hold ref at pos."""
    from seqweave.operators.genome import CHUNK, windows

    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).where(F.size(f) >= 8)
    rows = rows.select(*by, A.canonical_chrom(F.get(f, F.lit(0))).alias("chrom"), F.get(f, F.lit(1)).try_cast("int").alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), F.get(f, F.lit(7)).contains("FUNC=").alias("__func"))
    rows = windows(rows, genome, F.col("pos") - 1, F.col("pos") - 1 + F.length("ref"), "chrom", size or CHUNK)
    known = genome.select(F.col("contig").alias("chrom")).distinct().withColumn("__known", F.lit(True))
    return rows.join(known, "chrom", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("__func").alias("func_removed"), F.count_if(F.col("__known").isNull()).alias("unresolved_contigs"),
        F.count_if(F.col("__known") & ~F.col("__seq").eqNullSafe(F.col("ref"))).alias("reference_mismatches"),
    )


def sequence_alleles(records: DataFrame) -> DataFrame:
    """A row for each alternative that is a sequence over one: alt, alt_index (from 0) and the record's columns."""
    rows = records.select("*", F.posexplode("alts").alias("alt_index", "alt")).drop("alts")
    return rows.where(A.is_sequence_allele(F.col("ref")) & A.is_sequence_allele(F.col("alt"))).withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")})


def _value(field: str) -> Column:
    """INFO first, then the sample's value; a list stays joined by commas."""
    return F.coalesce(F.try_element_at("info", F.lit(field)), F.try_element_at("format", F.lit(field)))


def candidates(records: DataFrame, targets: DataFrame | None = None, genome: DataFrame | None = None, hotspots: bool = False) -> DataFrame:
    """Insertions and deletions with vcf_* columns, one row a key: the one of the greatest FAO, then QUAL, then the first.

    targets: merged intervals that the allele must overlap. genome: moves alleles left first. hotspots: HS records only,
    canonical contigs, the allele's own value of lists, and the filter reason's and fractions' columns.
    """
    rows = sequence_alleles(records).where(F.length("ref") != F.length("alt"))
    if hotspots:
        rows = rows.where(F.try_element_at("info", F.lit("HS")).isNotNull())
    if genome is not None:
        rows = normalized(rows.withColumn("contig", A.canonical_chrom(F.col("contig"))), genome, "contig")
    rows = rows.withColumns({"chrom": A.canonical_chrom(F.col("contig")), "start0": F.col("pos") - 1, "__end0": F.col("pos") - 1 + F.length("ref")})
    if targets is not None:
        rows = joined(rows, targets, "inner", False, "start0", "__end0", "chrom").drop("__s", "__e").dropDuplicates(["sample", "run", "ord", "alt_index"])
    own = (lambda c: A.allele_value(F.split(c, ","), F.col("alt_index"))) if hotspots else (lambda c: c)
    fields = A.CALL_FIELDS + (HOTSPOT_FIELDS if hotspots else ())
    out = rows.select(
        "sample", "run", "ord", F.col("chrom" if hotspots else "contig").alias("chrom"), "pos", "ref", "alt", A.locus_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("locus_id"),
        F.col("qual").alias("vcf_QUAL"), F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise(".").alias("vcf_FILTER"), F.try_element_at("format", F.lit("GT")).alias("vcf_GT"),
        *(own(_value(f)).alias(f"vcf_{f}") for f in fields), *([_value("FR").alias("caller_filter_reason")] if hotspots else []),
    )
    if hotspots:
        out = out.select("*", *A.filter_reason(F.col("caller_filter_reason")), *A.allele_fractions(F.col("vcf_AO"), F.col("vcf_DP"), F.col("vcf_FAO"), F.col("vcf_FDP")))
    return best_calls(out, ["sample", "run", "locus_id"], ["vcf_FAO", "vcf_QUAL"], "ord").drop("ord")


def truth_keys(records: DataFrame, genome: DataFrame | None = None, in_genotype: bool = False) -> DataFrame:
    """Distinct keys of all sequence alleles; in_genotype: only those that the genotype, where there is one, names."""
    rows = sequence_alleles(records)
    if in_genotype:
        gt = F.try_element_at("format", F.lit("GT"))
        named = F.array_contains(F.split(gt, r"[/|]"), (F.col("alt_index") + 1).cast("string"))
        rows = rows.where(gt.isNull() | named)
    rows = rows.withColumn("chrom", A.canonical_chrom(F.col("contig")))
    if genome is not None:
        rows = normalized(rows.select("chrom", "pos", "ref", "alt").distinct(), genome)
    return rows.select("chrom", "pos", "ref", "alt").distinct()


def in_regions(records: DataFrame, regions: DataFrame) -> DataFrame:
    """The records that overlap merged regions (canonical contigs), once each."""
    spans = records.withColumns({"__chrom": A.canonical_chrom(F.col("contig")), "__a": F.col("pos") - 1, "__b": A.end0(F.col("pos"), F.col("ref"))})
    key = [c for c in ("sample", "run", "ord") if c in records.columns]  # a record's number is its file's
    hits = joined(spans.select(*key, "__chrom", "__a", "__b"), regions, "inner", False, "__a", "__b", "__chrom").select(*key).distinct()
    return records.join(hits, key, "left_semi")


def pileup_candidates(records: DataFrame, genome: DataFrame, targets: DataFrame, min_support: int = 2, min_hp_length: int = 4, size: int | None = None) -> DataFrame:
    """Homopolymer insertions and deletions of pileup records with enough support, moved left, in the targets; of several
    with one key the one of most support, then the first."""
    from seqweave.operators.genome import CHUNK, with_context

    size = size or CHUNK
    counts = {f.lower(): A.count_value(F.split(F.try_element_at("format", F.lit(f)), ","), F.col("alt_index") + 1) for f in COUNT_FIELDS}
    rows = sequence_alleles(records).where(F.length("ref") != F.length("alt")).withColumns(counts | {"dp": F.try_element_at("format", F.lit("DP")).try_cast("long")})
    rows = rows.where(F.col("ad") >= min_support).withColumn("chrom", A.canonical_chrom(F.col("contig")))
    rows = normalized(rows, genome, "chrom", size).withColumns({"start0": F.col("pos") - 1, "__end0": F.col("pos") - 1 + F.length("ref")})
    rows = joined(rows, targets, "inner", False, "start0", "__end0", "chrom").drop("__s", "__e").dropDuplicates(["sample", "run", "ord", "alt_index"])
    rows = with_context(rows, genome, size=size)
    rows = rows.where(A.targeted_homopolymer(F.col("reference_match"), F.col("is_homopolymer_indel"), F.col("hp_ref_len"), F.col("hp_alt_len"), min_hp_length))
    w = Window.partitionBy("sample", "run", "chrom", "pos", "ref", "alt").orderBy(F.desc("ad"), "ord")
    best = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1")
    return best.select("sample", "run", "chrom", "pos", "ref", "alt", F.col("ad").alias("bam_alt_support"), F.col("adf").alias("bam_alt_forward_reads"), F.col("adr").alias("bam_alt_reverse_reads"), F.col("dp").alias("bam_discovery_depth"), F.when(F.col("dp") > 0, F.col("ad") / F.col("dp")).alias("bam_alt_fraction"), "hp_base", "hp_ref_len", "hp_alt_len", "hp_delta", "is_homopolymer_indel", "reference_match")
