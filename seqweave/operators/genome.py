"""Windows of a reference stored as chunks (contig, chunk, seq), where chunk k holds bases k * size to (k + 1) * size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.alleles import minimal_difference
from seqweave.functions.context import RUN_FLANK, changed_part, context_columns, moved_left, moves_left, moves_right, rotation, runs, uniform_base, without_prefix, without_suffix

from .intervals import merged
from .staging import staged

CHUNK = 4096


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns made once a row. They pass through a generator, as the optimizer would else put an expression's
    copy wherever a later one uses it, also inside of lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def windows(rows: DataFrame, genome: DataFrame, start: Column, end: Column, contig: str = "contig", size: int = CHUNK) -> DataFrame:
    """rows with __seq, the reference in [max(start, 0), end) cut at the contig's end, and __from, where it starts. Only
    distinct windows are fetched, so rows at one place share them."""
    rows = staged(rows)  # used twice: for the distinct windows and for the join
    ranged = rows.withColumns({"__from": F.greatest(start, F.lit(0)).cast("long"), "__to": end.cast("long")})
    spans = ranged.select(F.col(contig).alias("__c"), F.col("__from").alias("__wf"), F.col("__to").alias("__wt")).distinct()
    pieces = spans.withColumn("__chunk", F.explode(F.sequence(F.floor(F.col("__wf") / size), F.floor((F.greatest(F.col("__wt"), F.col("__wf") + 1) - 1) / size))))
    chunks = genome.select(F.col("contig").alias("__gc"), F.col("chunk").cast("long").alias("__gk"), F.col("seq").alias("__gs"))
    # Merged, as the planner would else judge the pieces by the length of a compressed file and send them all through the driver.
    got = pieces.hint("merge").join(chunks, (F.col("__c") == F.col("__gc")) & (F.col("__chunk") == F.col("__gk"))).groupBy("__c", "__wf", "__wt").agg(F.sort_array(F.collect_list(F.struct("__chunk", "__gs"))).alias("__parts"))
    whole = F.array_join(F.transform("__parts", lambda p: p["__gs"]), "")
    first = F.get("__parts", F.lit(0))["__chunk"] * size
    got = got.select("__c", "__wf", "__wt", F.upper(F.substring(whole, (F.col("__wf") - first + 1).cast("int"), (F.col("__wt") - F.col("__wf")).cast("int"))).alias("__seq"))
    on = (F.col(contig) == F.col("__c")) & (F.col("__from") == F.col("__wf")) & (F.col("__to") == F.col("__wt"))
    return ranged.hint("merge").join(got, on, "left").select(*rows.columns, "__from", F.coalesce("__seq", F.lit("")).alias("__seq"))


def with_context(alleles: DataFrame, genome: DataFrame, contig: str = "chrom", size: int = CHUNK) -> DataFrame:
    """alleles (pos, ref, alt, ...) with their sequence context."""
    start = F.col("pos") - 1
    end = start + F.greatest(F.length("ref"), F.lit(1))
    near = windows(alleles, genome, start - RUN_FLANK, end + RUN_FLANK, contig, size)
    before = (F.col("pos") - 1 - F.col("__from")).cast("int")
    near = near.withColumns({"__left": F.substring("__seq", F.lit(1), before), "__here": F.substring("__seq", before + 1, F.length("ref")), "__right": F.substring("__seq", before + 1 + F.length("ref"), F.lit(RUN_FLANK))})
    ref, alt = F.col("ref"), F.col("alt")
    near = computed(near, __diff=minimal_difference(ref, alt))
    near = computed(near, __base=uniform_base(changed_part(F.col("__diff"), ref, alt)))
    near = computed(near, __runs=runs(F.col("__left"), F.col("__right"), ref, F.col("__diff"), F.col("__base")))
    out = context_columns(F.col("__left"), F.col("__here"), F.col("__right"), F.col("pos"), ref, alt, F.col("__diff.prefix"), F.col("__base"), F.col("__runs"))
    return near.withColumns(out).drop("__left", "__here", "__right", "__seq", "__from", "__diff", "__base", "__runs")


def normalized(alleles: DataFrame, genome: DataFrame, contig: str = "chrom", size: int = CHUNK, reach: int = 256) -> DataFrame:
    """alleles with pos, ref and alt trimmed and, for indels, moved left as far as they go.

    Windows of `reach` bases are fetched for all; the few rows that use a whole window up go on from there with one 16
    times as long, a million bases at most, until none does. An allele on a contig that the reference lacks stays as it is.
    """
    upper = alleles.withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")})
    cut = computed(upper, __s=without_suffix(F.col("ref"), F.col("alt")))
    cut = cut.withColumns({c: F.substring(c, F.lit(1), F.length(c) - F.col("__s")) for c in ("ref", "alt")}).drop("__s")
    cut = computed(cut, __p=without_prefix(F.col("ref"), F.col("alt")))
    cut = cut.withColumns({"pos": (F.col("pos") + F.col("__p")).cast("int"), **{c: F.substring(c, F.col("__p") + 1, F.length(c)) for c in ("ref", "alt")}}).drop("__p")
    return _moved(cut, genome, contig, size, reach)


def _moved(plain: DataFrame, genome: DataFrame, contig: str, size: int, reach: int) -> DataFrame:
    names = plain.columns
    left = windows(plain, genome, F.col("pos") - 1 - reach, F.col("pos") - 1, contig, size)
    left = computed(left, __r=rotation(F.col("ref"), F.col("alt")))
    left = computed(left, __k=F.when(F.col("__r.simple"), moves_left(F.col("__seq"), F.col("ref"), F.col("__r.unit"))).otherwise(0))
    more = (F.col("__k") == F.length("__seq")) & (F.col("__k") > 0) & (F.col("pos") - F.col("__k") > 1)
    made = computed(left, __n=moved_left(F.col("__seq"), F.col("pos"), F.col("ref"), F.col("alt"), F.col("__r.unit"), F.col("__k")), __more=more)
    as_is = F.col("__k") == 0
    done = made.withColumns({c: F.when(as_is, F.col(c)).otherwise(F.col(f"__n.{c}")) for c in ("pos", "ref", "alt")})
    done = staged(done)
    again = done.where("__more").select(*names)
    if again.isEmpty():
        return done.select(*names)
    return done.where(~F.col("__more")).select(*names).unionByName(_moved(again, genome, contig, size, min(reach * 16, 1 << 20)))


def shown_regions(keys: DataFrame, genome: DataFrame, size: int = CHUNK, reach: int = 256) -> DataFrame:
    """Where reads may show the indels (chrom, pos, ref, alt), which lie as far left as they go: merged intervals (contig,
    start, end) from the anchor to where the last of their copies further right has its own, and a base on either side.

    Windows of `reach` bases are fetched; where an indel's repeat fills one, the next one is 16 times as long, a million
    bases at most, and goes on from there.
    """
    plain = keys.select("chrom", F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct()
    some, out = computed(plain, __r=rotation(F.col("ref"), F.col("alt"))).select("chrom", "pos", F.length("ref").alias("n"), F.when(F.col("__r.simple"), F.col("__r.unit")).alias("unit"), F.lit(0).cast("long").alias("far")), None
    while True:
        right = windows(some, genome, F.col("pos") + F.col("far"), F.col("pos") + F.col("far") + reach, "chrom", size)
        right = computed(right, __k=F.when(F.col("unit").isNotNull(), moves_right(F.col("__seq"), F.col("unit"))).otherwise(0))
        turn = F.col("__k") % F.length("unit")
        turned = F.concat(F.substring("unit", turn + 1, F.length("unit")), F.substring("unit", F.lit(1), turn))
        found = staged(right.select("chrom", "pos", "n", turned.alias("unit"), (F.col("far") + F.col("__k")).alias("far"), (F.col("__k") >= reach).alias("__more")))
        ends = found.where(~F.col("__more")).select(F.col("chrom").alias("contig"), (F.col("pos") - 2).alias("start"), (F.col("pos") + F.greatest("far", "n") + 1).alias("end"))
        out = ends if out is None else out.unionByName(ends)
        some = found.where("__more").drop("__more")
        if some.isEmpty():
            return staged(merged(out))
        reach = min(reach * 16, 1 << 20)
