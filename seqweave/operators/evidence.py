"""Read evidence for candidates: spanning reads, bounded samples, summaries, discovery and forced counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions import reads as R
from seqweave.functions.alleles import reverse_complement

from .genome import CHUNK, computed, normalized, shown_regions, windows, with_context
from .intervals import BIN, bins, coverage_at, joined
from .staging import measured, staged

#: Names of the three phase parameters.
ZP_NAMES = ("CF", "IE", "DR")
#: Bins of regions that are sent to all tasks; more meet the reads by a shuffle.
BROADCAST_BINS = 100_000


def summaries(name: str, value: Column | None = None) -> list[Column]:
    """Mean, median, population deviation and interquartile range of what is finite."""
    x = F.col(name) if value is None else value
    x = F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))), None).otherwise(x.cast("double"))
    q = lambda p: F.percentile(x, F.lit(p))
    return [F.avg(x).alias(f"{name}_mean"), q(0.5).alias(f"{name}_median"), F.stddev_pop(x).alias(f"{name}_sd"), (q(0.75) - q(0.25)).alias(f"{name}_iqr")]


#: Widths of bins of spanning reads: a read lies in at most two of the narrowest that is as wide as it is.
WIDTHS = tuple(1 << k for k in (6, 9, 12, 15, 19, 23, 27, 31))


def spanning(candidates: DataFrame, reads: DataFrame, key: list[str], by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Pairs of a candidate (key, `by`, chrom, start0, end0) and a usable read with the same `by` that covers it whole.

    Bins are a ladder of widths, so that short reads meet only candidates within about their own length. A read goes to its
    own width's bins, a candidate to its bin of every width. Merged, as the planner would else judge the candidates, a row
    a width, by the length of their compressed file, and send them all through the driver.
    """
    length = F.greatest(F.col("ref_end").cast("long") - F.col("ref_start"), F.lit(1))
    width = reduce(lambda c, w: c.when(length <= w, F.lit(w)), WIDTHS[1:-1], F.when(length <= WIDTHS[0], F.lit(WIDTHS[0]))).otherwise(F.lit(WIDTHS[-1]))
    sides = reads.where(R.usable(F.col("flag"))).withColumn("__width", width.cast("long"))
    own = lambda place: F.floor(place.cast("long") / F.col("__width"))
    sides = sides.withColumn("__bin", F.explode(F.sequence(own(F.col("ref_start")), own(F.col("ref_start") + length - 1))))
    levels = F.array(*(F.struct(F.lit(w).cast("long").alias("__cwidth"), F.floor(F.col("start0") / w).alias("__cbin")) for w in WIDTHS))
    wanted = candidates.select("*", F.inline(levels)).withColumnsRenamed({c: f"__{c}" for c in by})
    on = (wanted["chrom"] == sides["contig"]) & (wanted["__cwidth"] == sides["__width"]) & (wanted["__cbin"] == sides["__bin"]) & (sides["ref_start"] <= wanted["start0"]) & (sides["ref_end"] >= wanted["end0"])
    return wanted.hint("merge").join(sides, reduce(and_, (wanted[f"__{c}"] == sides[c] for c in by), on)).drop(*(f"__{c}" for c in by), "__cwidth", "__width", "__cbin", "__bin")


def _blake(token: Column) -> Column:
    """8 bytes of a text's BLAKE2b."""

    @F.arrow_udf("binary")
    def digests(tokens: pa.Array) -> pa.Array:
        return pa.array([hashlib.blake2b((t or "").encode(), digest_size=8).digest() for t in tokens.to_pylist()], pa.binary())

    return digests(token)


def sampled(pairs: DataFrame, key: list[str], most: int | None, hashed: Column | None = None) -> DataFrame:
    """At most `most` reads of each candidate, by an 8-byte BLAKE2b of name, flag and start unless `hashed` is given. Spark
    limits groups by rank before it shuffles them."""
    if most is None:
        return pairs
    if hashed is None:
        hashed = _blake(F.concat_ws("|", "qname", F.col("flag").cast("string"), F.col("ref_start").cast("string")))
    w = Window.partitionBy(*key).orderBy("__score", "read_id")
    return pairs.withColumn("__score", hashed).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank", "__score")


def _quantile(values: np.ndarray, first: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Quantiles between ranks of groups of sorted values that begin at `first` and are n; 0 where there are none."""
    place = np.maximum(n - 1, 0) * share
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    at = lambda k: values[np.minimum(first + k, len(values) - 1)]
    a, b = at(low), at(high)
    return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)


def _described(table: pa.Table, key: list[str], flags: list[str], numbers: list[str], begins: np.ndarray) -> pa.RecordBatch:
    """A row for each group of rows: counts and means of flags, and the four summaries of numbers that are finite."""
    size = np.diff(begins, append=table.num_rows)
    group = np.repeat(np.arange(len(begins)), size)
    out = {c: table.column(c).combine_chunks().take(pa.array(begins)) for c in key}
    out["__n"] = pa.array(size.astype(np.int64))
    for c in (*flags, *numbers):
        x = table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        ok = np.isfinite(x)
        x, g = x[ok], group[ok]
        n = np.bincount(g, minlength=len(size))
        none, many = n == 0, np.maximum(n, 1)
        mean = np.bincount(g, x, len(size)) / many
        if c in flags:
            out |= {f"{c}_count": pa.array(n.astype(np.int64)), f"{c}_mean": pa.array(mean, mask=none)}
            continue
        spread = np.sqrt(np.bincount(g, (x - mean[g]) ** 2, len(size)) / many)
        x = x[np.lexsort((x, g))] if len(x) else np.zeros(1)
        q = lambda share: _quantile(x, np.cumsum(n) - n, n, share)  # noqa: B023, E731
        made = {"mean": mean, "median": q(0.5), "sd": spread, "iqr": q(0.75) - q(0.25)}
        out |= {f"{c}_{name}": pa.array(v, mask=none) for name, v in made.items()}
    return pa.RecordBatch.from_pydict(out)


def described(values: DataFrame, key: list[str], flags: list[str], numbers: list[str]) -> DataFrame:
    """For each key __n (its rows), of flags (doubles) `_count` and `_mean` of those that are not null, and of numbers mean,
    median, population deviation and interquartile range of what is finite, as `summaries` has them.

    Rows go to their key once, as numbers; maps of values for each quantile would take ten times the place. A task holds a
    batch and the rows of one key.
    """

    def codes(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far
        for b in batches:
            if not b.num_rows:
                continue
            ends = pa.Table.from_batches([x.slice(k, 1) for x, k in ((held[0] if held else b, 0), (b, b.num_rows - 1))])
            if held and (codes(ends)[:, 0] == codes(ends)[:, 1]).all():
                held.append(b)
                continue
            table = pa.Table.from_batches([*held, b])
            known = codes(table)
            begins = np.flatnonzero(np.concatenate([[True], (known[:, 1:] != known[:, :-1]).any(axis=0)]))
            if len(begins) > 1:
                yield _described(table.slice(0, begins[-1]), key, flags, numbers, begins[:-1])
            held = table.slice(begins[-1]).combine_chunks().to_batches()
        if held:
            yield _described(pa.Table.from_batches(held), key, flags, numbers, np.zeros(1, np.int64))

    kinds = dict(values.dtypes)
    made = [f"`{c}` {kinds[c]}" for c in key] + ["__n long"] + [x for c in flags for x in (f"`{c}_count` long", f"`{c}_mean` double")] + [f"`{c}_{name}` double" for c in numbers for name in ("mean", "median", "sd", "iqr")]
    own = values.select(*key, *(F.col(c).cast("double").alias(c) for c in (*flags, *numbers)))
    return own.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ", ".join(made))


def read_features(candidates: DataFrame, reads: DataFrame, genome: DataFrame, flow_orders: DataFrame, key: list[str], window: int = 5, most: int | None = None, flow: bool = True, size: int = CHUNK, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """A row for each candidate (key, `by`, chrom, start0, end0, hp_base, hp_ref_len, hp_alt_len) with the BAM and flow
    summaries; without reads the counts are 0 and the rest null."""
    # Bases around a candidate go with it, as its reads share them.
    candidates = staged(candidates)
    around = windows(candidates, genome, F.col("start0") - 10, F.col("end0") + 10, "chrom", size)
    back, n = R.is_reverse(F.col("flag")), F.length(F.coalesce("seq", F.lit("")))
    if most is None:
        totals, near = None, spanning(around, reads, key, by=by)
    else:
        # With a bound on reads, pairs carry no bases or signals: those are fetched for the reads that are chosen.
        pairs = staged(spanning(around, reads.select(*by, "read_id", "qname", "flag", "contig", "ref_start", "ref_end"), key, by=by))
        totals = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("bam_coverage"), F.count_if(~back).alias("bam_forward_reads"), F.count_if(back).alias("bam_reverse_reads"))
        chosen = sampled(pairs, key, most).select(*dict.fromkeys([*around.columns, *by, "read_id"]))
        near = chosen.hint("merge").join(reads, [*by, "read_id"])
    near = near.withColumn("__back", back)
    near = near.withColumn("__aligned", R.alignment_evidence(F.col("cigar"), F.col("ref_start"), F.col("seq"), F.col("__back"), F.col("__seq"), F.col("__from"), F.col("start0"), F.col("end0"), 10))
    near = near.withColumn("__q", F.col("__aligned.place"))
    base = near.withColumns({
        "bam_mapq": F.col("mapq").cast("double"),
        "bam_softclip_base_fraction": F.col("__aligned.clipped"),
        "bam_candidate_read_position": F.col("__q") / F.greatest(n - 1, F.lit(1)),
        "bam_distance_to_read_end": F.least(F.col("__q"), n - 1 - F.col("__q")).cast("double"),
        "bam_local_mismatch_burden": F.col("__aligned.mismatch"),
        "bam_local_indel_burden": F.col("__aligned.indel"),
        **{f"flow_{name}": F.get("zp", F.lit(k)).cast("double") for k, name in enumerate(ZP_NAMES)},
    })
    base = base.join(flow_orders.select(*by, "rg", "fo"), [*by, "rg"], "left")
    able = F.lit(flow) & F.col("hp_base").isNotNull() & F.col("__q").isNotNull() & F.col("fo").isNotNull()
    base = computed(base, __sequenced=R.as_sequenced(F.col("seq"), F.col("__back")))
    wanted = F.when(F.col("__back"), reverse_complement(F.col("hp_base"))).otherwise(F.col("hp_base"))
    base = base.withColumn("__flow", R.flow_evidence(F.when(able, F.col("__sequenced")), F.col("fo"), F.col("zf"), F.col("zm"), F.col("__q"), wanted, window))
    signals, found = F.col("__flow.signals"), F.col("__flow.place").isNotNull()
    signal = F.get(signals, F.lit(window))
    to_ref, to_alt = F.abs(signal - F.col("hp_ref_len")), F.abs(signal - F.col("hp_alt_len"))
    names = [f"m{-o}" if o < 0 else f"p{o}" for o in range(-window, window + 1)]
    number = lambda c: c.cast("double")
    base = base.withColumns({
        "flow_candidate_signal": signal, "flow_ref_residual": to_ref, "flow_alt_residual": to_alt, "flow_residual_difference": to_ref - to_alt, "flow_neighbor_noise": F.col("__flow.noise"),
        **{f"flow_{name}_signal": F.get(signals, F.lit(k)) for k, name in enumerate(names)},
        "__high": number(F.col("mapq") >= 30), "__clipped": number(F.col("bam_softclip_base_fraction") > 0), "__found": F.when(found, 1.0), "__closer": number(F.when(found, to_alt < to_ref)),
        "__whole": number(F.col("__flow.used") == F.length("__sequenced")), "__forward": F.when(~F.col("__back"), 1.0),
    })
    bam = ["bam_mapq", "bam_softclip_base_fraction", "bam_candidate_read_position", "bam_distance_to_read_end", "bam_local_mismatch_burden", "bam_local_indel_burden"]
    flows = ["flow_candidate_signal", "flow_ref_residual", "flow_alt_residual", "flow_residual_difference", "flow_neighbor_noise", *(f"flow_{z}" for z in ZP_NAMES), *(f"flow_{x}_signal" for x in names)]
    got = described(base, key, ["__high", "__clipped", "__found", "__closer", "__whole", "__forward"], [*bam, *flows])
    # Without a bound, what is used is all there is.
    strands = [F.col("__n").alias("bam_coverage"), F.col("__forward_count").alias("bam_forward_reads"), (F.col("__n") - F.col("__forward_count")).alias("bam_reverse_reads")]
    got = got.select(
        *key, *(strands if totals is None else []), F.col("__n").alias("bam_reads_used"), F.col("__high_mean").alias("bam_mapq_ge30_fraction"), F.col("__clipped_mean").alias("bam_softclip_read_fraction"), F.col("__found_count").alias("flow_reads"),
        (F.col("__found_count") / F.col("__n")).alias("flow_read_fraction"), F.col("__whole_mean").alias("flow_reconstructed_fraction"), F.col("__closer_mean").alias("flow_fraction_alt_closer"),
        *(f"{c}_{s}" for c in [*bam, *flows] for s in ("mean", "median", "sd", "iqr")),
    )
    out = candidates.select(*key).hint("merge")
    out = out.join(got, key, "left") if totals is None else out.join(totals, key, "left").hint("merge").join(got, key, "left")
    counts = ["bam_coverage", "bam_forward_reads", "bam_reverse_reads", "bam_reads_used", "flow_reads"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def read_events(reads: DataFrame, genome: DataFrame, most: int | None = 50, uniform: bool = False, size: int = CHUNK, within: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each read's insertions and deletions as raw alleles: the read's columns (`keep` of them, if given), then chrom, pos,
    ref and alt. within: merged intervals that the anchor lies in."""
    kept = keep or reads.columns
    ops = R.placed(F.col("cigar"), F.col("ref_start"))
    found = computed(reads, __ops=ops)
    found = found.select(*dict.fromkeys([*kept, "contig"]), F.inline(R.indel_events(F.col("__ops"), F.col("seq"), most))).drop("n")
    if within is not None:
        anchors = found.withColumns({"__a": F.col("pos") - 1, "__b": F.col("pos")}).withColumnRenamed("contig", "__contig")
        found = joined(anchors, within, "left_semi", True, "__a", "__b", "__contig", few=BROADCAST_BINS).withColumnRenamed("__contig", "contig").drop("__a", "__b")
    near = windows(found, genome, F.col("pos") - 1, F.col("pos") + F.coalesce("deleted", F.lit(0)), "contig", size)
    near = near.where(F.length("__seq") == 1 + F.coalesce("deleted", F.lit(0))).where(F.col("__seq").rlike("^[ACGTN]+$"))
    anchor = F.substring("__seq", 1, 1)
    changed = F.coalesce("inserted", F.substring("__seq", F.lit(2), F.length("__seq")))
    if uniform:
        near = near.where(F.length(F.replace(changed, F.substring(changed, 1, 1), F.lit(""))) == 0)
    ref = F.when(F.col("deleted").isNull(), anchor).otherwise(F.col("__seq"))
    alt = F.when(F.col("deleted").isNull(), F.concat(anchor, F.col("inserted"))).otherwise(anchor)
    return near.select(*kept, F.col("contig").alias("chrom"), F.col("pos"), ref.alias("ref"), alt.alias("alt"))


def shown_alleles(reads: DataFrame, genome: DataFrame, targets: DataFrame, min_mapq: int = 20, most: int | None = 50, with_depth: bool = False, uniform: bool = False, size: int = CHUNK, by: tuple[str, ...] = ()) -> DataFrame:
    """Alleles that reads show in the merged targets (contig, start, end), with support by strand, depth at the anchor,
    mapping qualities, for each value of `by`.

    Raw alleles are counted once a read and interval, then the distinct ones are moved left and their counts merged:
    sums of support, the greatest depth, and mapping qualities as a histogram, whose percentiles are exact.
    """
    good = reads.where(R.usable(F.col("flag")) & (F.col("mapq") >= min_mapq))
    events = read_events(good.select(*by, "read_id", "flag", "mapq", "contig", "ref_start", "ref_end", "cigar", "seq"), genome, most, uniform, size, keep=[*by, "read_id", "flag", "mapq"])
    events = events.withColumns({"__a": F.col("pos") - 1, "__b": F.col("pos") - 1 + F.length("ref")})
    inside = joined(events, targets, "inner", False, "__a", "__b", "chrom").dropDuplicates([*by, "read_id", "chrom", "pos", "ref", "alt", "__s"])
    inside = staged(inside)
    back = R.is_reverse(F.col("flag"))
    raw = inside.groupBy(*by, "chrom", "pos", "ref", "alt", "__s", "__e", "mapq").agg(F.count(F.lit(1)).alias("n"), F.count_if(~back).alias("f"), F.count_if(back).alias("r"))
    if with_depth:
        # Depth is the coverage within the interval at the anchor base; an anchor outside has none.
        place = lambda contig: F.concat_ws("\x01", *by, contig)  # noqa: E731  contigs of each `by` apart
        within = (F.col("pos") - 1 >= F.col("__s")) & (F.col("pos") - 1 < F.col("__e"))
        raw = raw.withColumn("__place", place("chrom"))
        points = raw.where(within).select(F.col("__place").alias("contig"), (F.col("pos") - 1).alias("p")).distinct()
        depth = coverage_at(good.select(place("contig").alias("contig"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end")), points)
        depth = depth.select(F.col("contig").alias("__place"), (F.col("p") + 1).alias("pos"), "depth")
        raw = raw.join(depth, ["__place", "pos"], "left").withColumn("depth", F.when(within, F.col("depth")).otherwise(0))
    else:
        raw = raw.withColumn("depth", F.lit(0))
    raw = raw.select(*by, "chrom", F.col("pos").cast("int").alias("pos"), "ref", "alt", "mapq", "n", "f", "r", F.coalesce("depth", F.lit(0)).alias("depth"))
    moved = normalized(raw, genome, "chrom", size)
    out = moved.groupBy(*by, "chrom", "pos", "ref", "alt").agg(
        F.sum("n").alias("bam_alt_support"), F.sum("f").alias("bam_alt_forward_reads"), F.sum("r").alias("bam_alt_reverse_reads"), F.max("depth").alias("bam_discovery_depth"),
        (F.sum(F.col("mapq") * F.col("n")) / F.sum("n")).alias("bam_alt_mapq_mean"), F.percentile(F.col("mapq").cast("double"), F.lit(0.5), F.col("n")).alias("bam_alt_mapq_median"),
    )
    return out.withColumn("bam_alt_fraction", F.when(F.col("bam_discovery_depth") > 0, F.col("bam_alt_support") / F.col("bam_discovery_depth")))


def discovered(reads: DataFrame, genome: DataFrame, targets: DataFrame, min_mapq: int = 20, min_support: int = 2, most: int | None = 50, min_alt_fraction: float | None = None, uniform: bool = False, size: int = CHUNK, by: tuple[str, ...] = ()) -> DataFrame:
    """The shown alleles with enough support and, if asked for, a large enough share of the depth."""
    out = shown_alleles(reads, genome, targets, min_mapq, most, min_alt_fraction is not None, uniform, size, by).where(F.col("bam_alt_support") >= min_support)
    return out if min_alt_fraction is None else out.where(F.col("bam_alt_fraction") >= min_alt_fraction)


def discovery_counts(reads: DataFrame, genome: DataFrame, targets: DataFrame, min_mapq: int = 20, min_support: int = 2, most: int | None = 50, min_alt_fraction: float | None = None, min_hp_length: int | None = None, size: int = CHUNK, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """What discovery keeps and drops at each step, in long form: by, metric, value. A read counts once for each target
    that it overlaps."""
    known = genome.select("contig").distinct()
    groups = reads.select(*by).distinct()
    wanted = targets.join(known.withColumn("__known", F.lit(True)), "contig", "left").agg(F.count(F.lit(1)).alias("target_intervals"), F.count_if(F.col("__known").isNull()).alias("unresolved_target_intervals"))
    able = targets.join(known, "contig", "left_semi")
    fetched = joined(reads.select(*by, "flag", "mapq", "contig", "ref_start", F.greatest("ref_end", F.col("ref_start") + 1).alias("__to")), able, "inner", False, "ref_start", "__to")
    good = R.usable(F.col("flag"))
    fetched = fetched.groupBy(*by).agg(F.count(F.lit(1)).alias("reads_fetched"), F.count_if(good).alias("reads_usable"), F.count_if(good & (F.col("mapq") < min_mapq)).alias("reads_mapq_filtered"))
    alleles = staged(shown_alleles(reads, genome, able, min_mapq, most, min_alt_fraction is not None, min_hp_length is not None, size, by))
    supported = F.col("bam_alt_support") >= min_support
    shared = supported if min_alt_fraction is None else supported & F.coalesce(F.col("bam_alt_fraction") >= min_alt_fraction, F.lit(False))
    if min_hp_length is None:
        alleles = alleles.withColumns({"__hp": F.lit(True), "__long": F.lit(True)})
    else:
        described = with_context(alleles.select("chrom", "pos", "ref", "alt").distinct(), genome, size=size).select("chrom", "pos", "ref", "alt", F.col("is_homopolymer_indel").alias("__hp"), (F.greatest("hp_ref_len", "hp_alt_len") >= min_hp_length).alias("__long"))
        alleles = alleles.join(described, ["chrom", "pos", "ref", "alt"], "left").fillna(False, ["__hp", "__long"])
    kept = alleles.groupBy(*by).agg(
        F.sum("bam_alt_support").alias("raw_indel_observations"), F.count(F.lit(1)).alias("alleles_before_support_filter"), F.count_if(supported).alias("alleles_after_support_before_hp_filter"), F.count_if(supported & ~shared).alias("alleles_fraction_filtered"),
        F.count_if(shared & ~F.col("__hp")).alias("alleles_non_hp_filtered"), F.count_if(shared & F.col("__hp") & ~F.col("__long")).alias("alleles_short_hp_filtered"), F.count_if(shared & F.col("__hp") & F.col("__long")).alias("alleles_after_support_filter"),
    )
    wide = groups.crossJoin(wanted).join(fetched, [*by], "left").join(kept, [*by], "left")  # of one row of targets
    names = [c for c in wide.columns if c not in by]
    return wide.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("value")) for c in names))))


#: More contigs than these in one scan's filter: only the regions' ends over all contigs.
FILTERED_CONTIGS = 64


def near_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """The reads that touch merged regions; a read over several bins may stay several times.

    A scan skips what lies outside the regions of each contig, by its statistics of ref_start and contig; the rest meets
    the regions bin by bin.
    """
    ends = regions.groupBy("contig").agg(F.min("start").alias("a"), F.max("end").alias("b")).limit(FILTERED_CONTIGS + 1).collect()
    if not ends:
        return reads.where(F.lit(False))
    spans = lambda a, b: (F.col("ref_start") < b) & (F.col("ref_end") >= a)
    if len(ends) <= FILTERED_CONTIGS:
        reads = reads.where(reduce(or_, ((F.col("contig") == r["contig"]) & spans(r["a"], r["b"]) for r in ends)))
    sides = regions.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e")).withColumn("__rbin", F.explode(bins(F.col("__s"), F.col("__e"), BIN)))
    binned = reads.withColumn("__bin", F.explode(bins(F.col("ref_start"), F.col("ref_end") + 1, BIN)))
    on = (F.col("contig") == F.col("__c")) & (F.col("__bin") == F.col("__rbin")) & spans(F.col("__s"), F.col("__e"))
    return binned.join(measured(sides, BROADCAST_BINS), on, "left_semi").drop("__bin")


def forced_counts(keys: DataFrame, reads: DataFrame, genome: DataFrame, min_mapq: int = 20, size: int = CHUNK, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Coverage by spanning reads and support by reads that show the normalised allele, for each key (`by`, chrom, pos,
    ref, alt). The fraction may pass 1, as support does not ask for spanning.

    Only reads near the keys are walked, and only events where a key's copies may lie are moved left.
    """
    names = [*by, "chrom", "pos", "ref", "alt"]
    keys = staged(keys.select(*names).distinct())  # used for coverage, regions and support
    good = reads.where(R.usable(F.col("flag")) & (F.col("mapq") >= min_mapq))
    wanted = keys.withColumns({"start0": F.col("pos") - 1, "end0": F.col("pos") - 1 + F.greatest(F.length("ref"), F.lit(1))})
    coverage = spanning(wanted, good, names, by=by).groupBy(*names).agg(F.count(F.lit(1)).alias("coverage"))
    longest = keys.agg(F.max(F.greatest(F.length("ref"), F.length("alt")))).first()[0] or 0
    regions = shown_regions(keys, genome, size)
    close = near_regions(good.select(*by, "read_id", "flag", "contig", "ref_start", "ref_end", "cigar", "seq"), regions)
    events = read_events(close, genome, max(50, longest), False, size, regions, [*by, "read_id", "flag"])
    events = events.where(F.greatest(F.length("ref"), F.length("alt")) - 1 <= max(50, longest))
    moved = normalized(events.withColumn("pos", F.col("pos").cast("int")), genome, "chrom", size).dropDuplicates([*by, "read_id", "chrom", "pos", "ref", "alt"])
    back = R.is_reverse(F.col("flag"))
    # Keys grow with the reads, so they go to the joins by a shuffle however short their file is.
    support = moved.join(keys.hint("merge"), names, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("alt_support"), F.count_if(~back).alias("alt_forward_reads"), F.count_if(back).alias("alt_reverse_reads"))
    out = wanted.select(*names).hint("merge").join(coverage, names, "left").hint("merge").join(support, names, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("coverage", "alt_support", "alt_forward_reads", "alt_reverse_reads")})
    return out.withColumn("alt_fraction", F.when(F.col("coverage") > 0, F.col("alt_support") / F.col("coverage")))
